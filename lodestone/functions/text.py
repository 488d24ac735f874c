"""Text functions: tokens, normalisation, splitting, ratios, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes (the JVM's \w knows ASCII only, so letters and digits are spelled out).
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4E00}-\x{9FFF}]"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
# Question words that mark a query as one for deep retrieval.
DEEP_WORDS = ("对比", "比较", "为什么", "为何", "分析", "总结", "归纳", "综合", "论述", "评价", "优缺点", "多个", "哪些", "列出所有", "详细", "深入")
# Markers of text read in a wrong encoding.
MOJIBAKE = ("佸", "绋", "鏂", "瀹", "搧", "槗", "攢", "€", "�")


def tokens(c: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def token_count(c: Column) -> Column:
    """Estimated model tokens: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def truncate_tokens(c: Column, n: int) -> Column:
    return F.substring(c, 1, 4 * n)


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def western_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, "0123456789" * 2)


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def exact_term(c: Column) -> Column:
    """Identifier form: half width, lower case, single spaces."""
    return F.lower(collapse_space(half_width(c)))


def space_latin_cjk(c: Column) -> Column:
    """A space between Latin letters or digits and CJK characters, both ways."""
    return F.regexp_replace(F.regexp_replace(c, f"([A-Za-z0-9]+)({CJK}+)", "$1 $2"), f"({CJK}+)([A-Za-z0-9]+)", "$1 $2")


def escape_query(c: Column) -> Column:
    """Backslash before characters that full-text query syntax reserves."""
    return F.regexp_replace(c, r'([:\{\}/\[\]\-\*"\(\)\|\+~\^])', r"\\$1")


def cjk_ratio(c: Column) -> Column:
    """Share of CJK characters among those that are not blank, six digits."""
    solid = F.regexp_replace(c, r"\s", "")
    return F.when(F.length(solid) == 0, 0.0).otherwise(F.round((F.length(solid) - F.length(F.regexp_replace(solid, CJK, ""))) / F.length(solid), 6))


def latin_ratio(c: Column) -> Column:
    """Share of ASCII letters, digits and common punctuation among all characters, six digits."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.round((F.length(c) - F.length(F.regexp_replace(c, r"[a-zA-Z0-9 ,.?:;'\"!\n-]", ""))) / F.length(c), 6))


def tight_punctuation(c: Column) -> Column:
    """No blank before closing or after opening punctuation."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?\)\]])", "$1"), r"([\(\[])\s+", "$1")


def strip_code_fence(c: Column) -> Column:
    """The inside of a fenced markdown block."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(markdown|md)?[ \t]*\n", ""), r"\n?```$", "")


def strip_position_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"@@[\t0-9.-]+?##", "")


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, r"</?(table|td|caption|tr|th)( [^<>]{0,12})?>", " ")


def slug(c: Column) -> Column:
    """Lower-case name of letters, digits and dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def entity_name(c: Column) -> Column:
    """Upper case, without quotes and control characters."""
    return F.upper(F.trim(F.regexp_replace(c, r'["\x00-\x1f\x7f-\x9f]', "")))


def split_markers(c: Column, markers: list[str]) -> Column:
    """Parts between any of the markers, trimmed, without empty ones."""
    import re

    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?。！？\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def highlight(c: Column, terms: list[str]) -> Column:
    """Sentences with a term, terms emphasised, joined by an ellipsis; whole words, any case."""
    pattern = "(?i)\\b(" + "|".join(terms) + ")\\b"
    hits = F.filter(sentences(c), lambda x: x.rlike(pattern))
    return F.array_join(F.transform(hits, lambda x: F.regexp_replace(x, pattern, "<em>$1</em>")), "...")


def retrieval_strategy(c: Column) -> Column:
    """precise for code, deep for reasoning or long questions, light for short ones."""
    q = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(q == "", "deep")
        .when(q.contains("```") | q.rlike(r"\b(def|class|import|function)\b"), "precise")
        .when(q.rlike("|".join(DEEP_WORDS)), "deep")
        .when((F.length(q) < 18) & ~q.rlike(r"[？?\n]"), "light")
        .otherwise("deep")
    )


def length_bucket(n: Column) -> Column:
    return F.when(n <= 800, "short").when(n <= 3000, "medium").when(n <= 8000, "long").otherwise("very_long")


def mojibake_count(c: Column) -> Column:
    """Occurrences of all markers."""
    return sum((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m) for m in MOJIBAKE).cast("int")


def duplicate_key(c: Column) -> Column:
    """A file stem without trailing copy numbers, lower case, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"([_-]\d+)+$", ""), r"\s+", " ")


def query_hash(c: Column) -> Column:
    return F.sha2(F.lower(collapse_space(c)), 256)


def heading_level(c: Column) -> Column:
    """Number of leading # of a markdown heading, 0 for other lines."""
    return F.length(F.regexp_extract(c, r"^(#{1,6})\s", 1))


# Families of numbered headings, from the outermost level.
BULLETS = (
    (r"^第[零一二三四五六七八九十百0-9]+(分?编|部分)", r"^第[零一二三四五六七八九十百0-9]+章", r"^第[零一二三四五六七八九十百0-9]+节", r"^第[零一二三四五六七八九十百0-9]+条", r"^[(（][零一二三四五六七八九十百]+[)）]"),
    (r"^第[0-9]+章", r"^第[0-9]+节", r"^[0-9]{0,2}[. 、]", r"^[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]", r"^[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}", r"^[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}"),
    (r"^第[零一二三四五六七八九十百0-9]+章", r"^第[零一二三四五六七八九十百0-9]+节", r"^[零一二三四五六七八九十百]+[ 、]", r"^[(（][零一二三四五六七八九十百]+[)）]", r"^[(（][0-9]{0,2}[)）]"),
    (r"^PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", r"^Chapter (I+V?|VI*|XI|IX|X)", r"^Section [0-9]+", r"^Article [0-9]+"),
    (r"^#[^#]", r"^##[^#]", r"^###.*", r"^####.*", r"^#####.*", r"^######.*"),
)


def bullet_level(c: Column, family: int) -> Column:
    """1-based level in a family of numbered headings, null for body lines."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(i + 1)) for i, p in enumerate(BULLETS[family])])


def lexical_idf(frequency: Column, total: float) -> Column:
    return F.log10(10 + (total - frequency + 0.5) / (frequency + 0.5))


def shingles(c: Column, n: int) -> Column:
    """Distinct word n-grams; of fewer words all of them together. The words are found once a step, not once an n-gram."""
    w = words(c)
    grams = w
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(w, F.lit(k + 1), F.size(w)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(F.array_compact(grams)))


def utf8_truncate(c: Column, n: int) -> Column:
    """The longest whole-character prefix of at most n bytes."""
    raw = F.encode(c, "UTF-8")
    cut = F.substring(raw, 1, n)
    # a byte that starts a character is not of the form 10xxxxxx
    back = F.when(F.octet_length(raw) <= n, F.lit(0)).otherwise(
        F.coalesce(*[F.when(~F.hex(F.substring(raw, n + 1 - k, 1)).rlike("^[89AB]"), F.lit(k)) for k in range(4)])
    )
    return F.decode(F.substring(cut, F.lit(1), F.lit(n) - back), "UTF-8")
