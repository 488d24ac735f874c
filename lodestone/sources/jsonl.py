"""JSON and JSON lines in parts of bounded size."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame


def is_jsonl(text: str) -> bool:
    """At least four fifths of the first ten non-empty lines are JSON on their own, and there are two or more."""
    lines = [x for x in text.split("\n") if x.strip()][:10]
    good = 0
    for line in lines:
        try:
            json.loads(line)
            good += 1
        except ValueError:
            pass
    return len(lines) > 1 and good >= 0.8 * len(lines)


def split_value(value, most: int, path: tuple = ()) -> list[dict]:
    """Nested dicts whose JSON has at most ``most`` characters where the leaves allow it."""
    def put(tree: dict, keys: tuple, leaf) -> None:
        for k in keys[:-1]:
            tree = tree.setdefault(k, {})
        tree[keys[-1]] = leaf

    out: list[dict] = [{}]

    def walk(v, keys: tuple) -> None:
        if isinstance(v, list):
            v = {str(i): x for i, x in enumerate(v)}
        if isinstance(v, dict) and v and len(json.dumps(v, ensure_ascii=False)) + len(json.dumps(out[-1], ensure_ascii=False)) > most:
            for k, x in v.items():
                walk(x, (*keys, k))
            return
        if out[-1] and len(json.dumps(out[-1], ensure_ascii=False)) + len(json.dumps(v, ensure_ascii=False)) > most:
            out.append({})
        put(out[-1], keys or ("value",), v)

    walk(value, path)
    return [x for x in out if x]


def split(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, idx, text) of each document's parts; text that is no JSON is one part."""

    def parts(text: str) -> list[str]:
        try:
            values = [json.loads(x) for x in text.split("\n") if x.strip()] if is_jsonl(text) else [json.loads(text)]
        except ValueError:
            return [text]
        return [json.dumps(p, ensure_ascii=False) for v in values for p in split_value(v, most)]

    def task(batches):
        for pdf in batches:
            rows = [(key, i, p) for key, text in zip(pdf[id_col], pdf[text_col], strict=True) if text for i, p in enumerate(parts(text))]
            yield pd.DataFrame(rows, columns=["id", "idx", "text"])

    return docs.select(id_col, text_col).mapInPandas(task, "id long, idx int, text string")
