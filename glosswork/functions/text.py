"""Column expressions over text: letters, scripts, normal forms, names and sizes. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as Han, and those that make a text Japanese or Korean.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{2F800}-\x{2FA1F}\x{3005}\x{3007}"
KANA_HANGUL = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}"
# Grammar of document codes and revisions.
CODE = r"(?<![A-Za-z0-9-])[A-Z]{2,6}(?:-[A-Z0-9]{2,8}){1,4}-?\d{1,4}(?![A-Za-z0-9-])"
REVISION = r"(?i)(?<![A-Za-z0-9])Rev(?:ision)?\.?\s*([0-9]{1,4})\b"
# Hints in file names, in the order they are tried.
TYPE_HINTS = [
    ("WORK_INSTRUCTION", ["wi-", "wi_", "work instruction", "instruksi kerja"]),
    ("GUIDELINE", ["guideline", "panduan", "pedoman"]),
    ("POLICY", ["policy", "kebijakan"]),
    ("MANUAL", ["manual", "buku panduan"]),
    ("REPORT", ["report", "laporan"]),
    ("RECORD", ["record", "rekaman", "catatan"]),
    ("SOP", ["sop", "standard operating"]),
    ("FORM", ["form", "formulir", "frm-", "frm_"]),
]
# Parts of keys whose values are never shown, and what is shown for them.
SECRETS = ["password", "secret", "token", "credential", "certificate", "api_key", "apikey", "private_key", "remember_token", "authorization"]
REDACTED = "[redacted]"
# Names of the languages in descriptions.
LANGUAGE_NAMES = {"en": "English", "id": "Indonesian", "zh": "Chinese"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def letters(text: Column) -> Column:
    """Only the alphabetic characters of a text."""
    return F.regexp_replace(text, r"[^\p{L}]", "")


def han(text: Column) -> Column:
    """The Han characters of a text; none if it has kana or hangul, since its Han is then not Chinese."""
    return F.when(is_cjk_other(text), "").otherwise(F.regexp_replace(text, f"[^{HAN}]", ""))


def is_cjk_other(text: Column) -> Column:
    return text.rlike(f"[{KANA_HANGUL}]")


def not_han(text: Column) -> Column:
    """A text without its Han characters."""
    return F.regexp_replace(text, f"[{HAN}]", "")


def words(text: Column) -> Column:
    """Words between white space; digits count as words."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def line_key(text: Column) -> Column:
    """A line as it is compared with others: letters and blanks, small, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\s\p{Z}]", "")), r"[\s\p{Z}]+", " "))


def effective_length(text: Column) -> Column:
    """Length with a Han character counted three times."""
    return F.length(text) + 2 * F.length(F.regexp_replace(text, f"[^{HAN}]", ""))


def document_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CODE, 0), F.lit(""))


def revision(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, REVISION, 1), F.lit(""))


def item_id(path: Column) -> Column:
    return F.sha2(F.lower(path), 256)


def title_from_name(name: Column) -> Column:
    stem = F.trim(F.regexp_replace(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "), r"\s+", " "))
    return F.coalesce(F.nullif(stem, F.lit("")), name)


def guess_type(name: Column) -> Column:
    low = F.lower(name)
    cases = [(t, reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in hints])) for t, hints in TYPE_HINTS]
    return reduce(lambda out, case: out.when(case[1], case[0]), cases[1:], F.when(cases[0][1], cases[0][0])).otherwise("OTHER")


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    n = size.cast("double")
    one = lambda by, unit: F.format_string(f"%.1f {unit}", F.round(n / by, 1))
    return (
        F.when(n < 1024, F.format_string("%d B", size.cast("bigint")))
        .when(n < 1024**2, one(1024, "KB"))
        .when(n < 1024**3, one(1024**2, "MB"))
        .otherwise(one(1024**3, "GB"))
    )


def human_duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "—").when(ms < 1000, F.format_string("%d ms", ms)).otherwise(F.format_string("%.1f s", F.round(ms / 1000, 1)))


def colour(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "^#+", ""))


def redact(values: Column, secrets: list[str] | None = None) -> Column:
    """A map with the values of sensitive keys replaced; null stays null."""
    return F.transform_values(values, lambda k, v: F.when(_secret(k, secrets), F.lit(REDACTED)).otherwise(v))


def redact_nested(values: Column, secrets: list[str] | None = None) -> Column:
    """A map of maps with the values of sensitive keys replaced inside; the outer keys only name groups."""
    return F.transform_values(values, lambda _, v: redact(v, secrets))


def _secret(key: Column, secrets: list[str] | None) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(key), F.lit(s)) for s in secrets or SECRETS])


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """What a user's pattern finds first, trimmed; null without a match, for a blank match, for a group that the pattern lacks,
    and for a pattern that does not compile (it is tried on the driver, once)."""
    none = F.lit(None).cast("string")
    try:
        compiled = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return none
    if group > compiled.matcher("").groupCount():
        return none
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The folder of a path, "" at the root."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"^(.*)/[^/]*$", 1)


def safe_file_name(name: Column) -> Column:
    """A file name without folders, control characters, marks that file systems keep for themselves, leading dots and
    device names; at most 200 characters, "document" if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(base_name(name), r"[\x00-\x1F\x7F]", ""), r'[<>:"|?*]', "_")
    plain = F.trim(F.regexp_replace(plain, r"^[. ]+", ""))
    device = F.regexp_replace(plain, r"\.[^.]*$", "").rlike(r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    kept = F.when(device, F.concat(F.lit("_"), plain)).otherwise(plain)
    return F.when(plain == "", "document").otherwise(F.substring(kept, 1, 200))


def truncated(text: Column, most: int = 255) -> Column:
    return F.substring(text, 1, most)


def language_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])[code], code)
