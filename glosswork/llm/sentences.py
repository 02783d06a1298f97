"""Sentence boundaries across languages and scripts (problem 3), in SQL expressions only.

A shadow of the text of the same length in code points is made by `translate` (widths, look-alikes and
blanks to their plain form, invisible characters to a filler). On it, every full stop that ends nothing
(decimals, dates, versions, URLs, abbreviations, initials, ordinals before a month, list marks, dots in
mid-sentence, anything inside a quotation that goes on) is replaced by a private-use placeholder, one for
one. Terminator patterns of each script then put a cut mark after every sentence; the pieces' lengths give
the offsets, and the sentence itself is the stored text between them, so nothing needs undoing and no
placeholder can leak.

Edge cases: null and blank texts have no sentence; text after the last end mark is one; a text of any
length is read whole; pieces without a letter or digit join nothing and are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.text_forms import one_to_one

FILL, STOP, ASK, CRY, WIDE, CUT = "", "", "", "", "", ""
#: up to a few invisible characters may stand anywhere, in texts that have any
BLANKS = " \t\n\r\x0b\x0c"
LOOSE = f"{FILL}{{0,4}}"

# Abbreviations by language after which a sentence goes on whatever follows.
ABBREVIATIONS = {
    "en": "No Nos Fig Figs Sec Tab Bldg Rev Vol Ch Eq ext approx max min vs e.g i.e cf Dr Mr Mrs Ms Prof St Sr Jr Dept Art",
    "id, ms": "No Gbr Bhg Raj Tab hlm hal tgl mis maks min s.d a.n u.p d.a Jl Jln PT CV Bpk Yth Rev Bil",
    "de": "Nr Abb Abschn Kap Tab S Bd ca bzw max min z.B z. d.h u.a i.d.R vgl ggf inkl Dr Prof Str sog evtl",
}
# Abbreviations that may also end a sentence; it goes on if a small letter or a digit follows.
CLOSING = "etc Inc Ltd Co Corp a.m p.m dll dsb dst usw Tbk Bhd GmbH"
# Raised digits, which number things like plain ones.
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"
# Month names that follow the ordinal of a day.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"

CJK = "\\x{2E80}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}\\x{AC00}-\\x{D7AF}"
THAI = "\\x{0E00}-\\x{0E7F}"
ENDS, WIDE_ENDS, CLOSERS = "[.!?]", "[。！？｡．]", "[\"”’»」』)）\\]】]"


def _spelt(word: str, gap: str) -> str:
    """Pattern of a word whose stops may be masked already and which `gap` may interrupt."""
    return gap.join(f"(?:\\.|{STOP}) ?" if c == "." else c for c in word)


def _any(words: str, gap: str) -> str:
    return "|".join(_spelt(w, gap) for w in sorted(set(words.split()), key=lambda w: (-len(w), w)))


def _masks(gap: str) -> list[tuple[str, str]]:
    """(pattern, replacement) in order; every replacement keeps the length. $-groups stand for copied text.

    Patterns begin with the stop and look back, so nothing is tried anywhere else.
    """
    _ = gap
    word = "(?<![\\p{L}\\d])"
    return [
        # a list mark that opens the segment, with a bracket or a stop
        (f"^([\\s{FILL}]*[(（]?{_}(?:\\d{{1,3}}|\\p{{L}}){_}(?:{STOP}?))\\.(?=[)）\\s{FILL}\\p{{L}}])", f"$1{STOP}"),
        # decimals, dates, clock times, versions, numbered sections
        (f"\\.(?<=\\d{_}\\.)(?={_}\\d)", STOP),
        # ordinals before a month
        (f"\\.(?<=\\d{_}\\.)(?={_} ?{_}(?:{_any(MONTHS, gap)})(?!\\p{{L}}))", STOP),
        # two letters with a stop each, written together or apart: the stop inside
        (f"\\.(?<={word}\\p{{Ll}}{_}\\.)(?={_} ?{_}\\p{{L}}{_}\\.)", STOP),
        (f"\\.(?<={word}(?:{_any(' '.join(ABBREVIATIONS.values()), gap)}){_}\\.)(?=[\\s{FILL}]*[\\p{{L}}\\d\\p{{S}}(])", STOP),
        (f"\\.(?<={word}(?:{_any(CLOSING, gap)}){_}\\.)(?=[\\s{FILL}]*[\\p{{Ll}}\\d,;])", STOP),
        # initials: one before another, the last of several, and one after a word
        (f"\\.(?<={word}\\p{{Lu}}{_}\\.)(?={_} ?{_}\\p{{Lu}}{_}\\.)", STOP),
        (f"\\.(?<=\\p{{Lu}}{_}{STOP}{_} ?{_}\\p{{Lu}}{_}\\.)(?={_} {_}\\p{{Lu}}{_}\\p{{Ll}})", STOP),
        (f"\\.(?<=[\\p{{L}},)] \\p{{Lu}}{_}\\.)(?= {_}\\p{{Lu}}\\p{{Ll}})", STOP),
        # dots in mid-sentence
        (f"\\.(?={_}\\.)", STOP),
        (f"({STOP}{_})\\.(?=[\\s{FILL}]*(?:[\\p{{Ll}}\\d{CJK},;:]|{STOP}))", f"$1{STOP}"),
        # a stop before a comma or a small letter
        (f"\\.(?=[\\s{FILL}]*[\\p{{Ll}},;:])", STOP),
    ]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _shadow(text: Column) -> Column:
    source, result = one_to_one()
    source, result = RAISED + source, "0123456789" + result
    # translate removes what has no counterpart, so invisible characters are turned into the filler explicitly
    return F.translate(text, source, result + FILL * (len(source) - len(result)))


def _mask(shadow: Column, gap: str) -> Column:
    # URLs and addresses, each between blanks: every mark before a letter, digit or slash
    named = lambda x: F.contains(x, F.lit("://")) | F.contains(x, F.lit("www.")) | F.contains(x, F.lit("@"))
    inner = lambda w: F.regexp_replace(F.regexp_replace(w, r"\.(?=[A-Za-z\d/_~%-])", STOP), r"\?(?=[A-Za-z\d])", ASK)
    url = F.array_join(F.transform(F.split(shadow, r"(?<=\s)"), lambda w: F.when(named(w), inner(w)).otherwise(w)), "")
    stops = reduce(lambda x, step: F.regexp_replace(x, *step), _masks(gap), F.when(named(shadow), url).otherwise(shadow))
    out = F.when(F.contains(shadow, F.lit(".")), stops).otherwise(shadow)
    marks = ".!?。！？｡．", STOP + ASK + CRY + WIDE * 5

    def quoted(s: Column, opening: str, closing: str) -> Column:
        """Terminators inside a quotation are masked: the quotation is part of the sentence around it."""
        pieces = F.split(s, opening)

        def part(x: Column, i: Column) -> Column:
            end = F.instr(x, closing)
            inside = F.substring(x, F.lit(1), end - 1)
            return F.when((i == 0) | (end == 0), x).otherwise(F.concat(F.translate(inside, *marks), F.substring(x, end, F.length(x))))

        return F.array_join(F.transform(pieces, part), opening)

    def straight(pieces: Column) -> Column:
        inside = lambda i: (i % 2 == 1) & (i < F.size(pieces) - 1)
        return F.array_join(F.transform(pieces, lambda x, i: F.when(inside(i), F.translate(x, *marks)).otherwise(x)), '"')

    def either(opening: str, closing: str) -> Callable[[Column], Column]:
        return lambda s: F.when(F.contains(s, F.lit(closing)), quoted(s, opening, closing)).otherwise(s)

    for opening, closing in (("“", "”"), ("「", "」"), ("『", "』"), ("„", "“"), ("»", "«")):
        out = let(out, either(opening, closing))
    out = let(out, lambda s: F.when(F.contains(s, F.lit('"')), straight(F.split(s, '"'))).otherwise(s))
    # A quotation with its own end mark that nothing but the next sentence follows ends there.
    _ = gap
    ends = f"([{STOP}{ASK}{CRY}{WIDE}]{_})([\"”」』]{_})"
    stands = f"(?=[\\s{FILL}]*$|[ ]{_}[(\"“]?{_}\\p{{Lu}}\\p{{Ll}}|\\n)"
    return F.regexp_replace(out, ends + stands, f"$1$2{CUT}")


def _cuts(masked: Column, gap: str) -> Column:
    """Cut marks after every sentence; newlines always part."""
    _ = gap
    steps = [
        (f"({WIDE_ENDS}(?:{_}(?:{WIDE_ENDS}|{ENDS}))*(?:{_}{CLOSERS})*{_}(?=[\\s{FILL}]|$)|{WIDE_ENDS}(?:{_}(?:{WIDE_ENDS}|{ENDS}))*(?:{_}{CLOSERS})*)", f"$1{CUT}"),
        (f"({ENDS}(?:{_}{ENDS})*(?:{_}{CLOSERS})*{_})(?=\\s|$)", f"$1{CUT}"),
        (f"({ENDS}(?:{_}{ENDS})*(?:{_}{CLOSERS})*)(?={_}[(（\"“]?{_}(?:\\p{{Lu}}|[{CJK}{THAI}]))", f"$1{CUT}"),
        (f"(\\n+)(?=[^\\n])", f"$1{CUT}"),
        # Thai: a blank parts sentences unless it stands beside a number
        (f"([{THAI}]{_})( +)(?={_}[{THAI}(\"“])", f"$1$2{CUT}"),
    ]
    return reduce(lambda s, step: F.regexp_replace(s, *step), steps, masked)


def spans(text: Column) -> Column:
    """array<struct<char_start:int,char_end:int>> of the sentences of `text`, 0-based code points, end exclusive."""
    def cut(gap: str) -> Callable[[Column], Column]:
        return lambda s: F.split(_cuts(_mask(s, gap), gap), CUT)

    pieces = let(_shadow(text), lambda s: F.when(F.contains(s, F.lit(FILL)), cut(LOOSE)(s)).otherwise(cut("")(s)))
    return let(pieces, _offsets)


def _offsets(pieces: Column) -> Column:
    sized = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(p).alias("n"),
            (F.length(p) - F.length(F.ltrim(p, F.lit(BLANKS)))).alias("head"),
            (F.length(p) - F.length(F.rtrim(p, F.lit(BLANKS)))).alias("tail"),
            p.rlike(r"[\p{L}\p{N}]").alias("said"),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char_start:int,char_end:int>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + p["head"]).alias("char_start"), (acc["at"] + p["n"] - p["tail"]).alias("char_end"))
        return F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["said"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(sized, zero, add, lambda acc: acc["spans"])



def body(segments: DataFrame) -> DataFrame:
    """Segments that carry text of their own; a null kind counts as body."""
    return segments.filter(~F.coalesce(F.col("kind"), F.lit("")).isin("heading", "header", "footer"))


def sentence_rows(segments: DataFrame, key: str = "seg_id", text: str = "text") -> DataFrame:
    """key, char_start, char_end, sentence: one row per sentence of each row of `segments`."""
    found = segments.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t"), F.explode(spans(F.col(text))).alias("_s"))
    cut = F.substring(F.col("_t"), F.col("_s.char_start") + 1, F.col("_s.char_end") - F.col("_s.char_start"))
    return found.select(key, "_s.char_start", "_s.char_end", cut.alias("sentence"))


def sentence_spans(segments: DataFrame) -> DataFrame:
    """Every sentence of every body segment as seg_id, char_start, char_end; segments delivered twice count once."""
    found = body(segments).filter(F.col("text").isNotNull()).select("seg_id", F.explode(spans(F.col("text"))).alias("s"))
    return found.select("seg_id", "s.char_start", "s.char_end").distinct()
