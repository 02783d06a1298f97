"""Timestamps in mixed formats and zones to UTC microseconds (problem 5).

Every value is read in all ways it can be read: an array of (label, utc_us, prior), built in SQL
expressions only. `label` is the day-month order a numeric date was read with, `form` the pattern with
its separator and order, `prior` what that reading costs by itself (against the configured order). A
Viterbi pass over each source's records in order then picks one reading per value: it pays `SWITCH`
whenever the day-month order changes from one numeric date of a source to the next, `FORM` whenever
the form of a record is not that of the one before, and `BACKWARD` whenever time runs backwards. The
configured order outweighs all of these, so it is kept; where a source has none, the pass decides.

The pass is distributed. A source may hold any share of the rows, so its records are cut into
blocks of `BLOCK` consecutive ids. A block is reduced to its min-plus transition matrix (states of
its first record x states of its last), the matrices of a source are chained (one narrow row a
block), and each block then looks up the path for the entry and exit state the chain chose.

Edge cases: null, empty and placeholder values, impossible dates and unknown zones have no reading
and give no row; a local time without a known source zone has none either. A local time that occurs
twice is its first occurrence, one that never occurs is read with the offset before the change
(both are java.time's rule, which `to_utc_timestamp` follows). Fractions are cut to microseconds.
Rows delivered twice count once.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from glosswork.session import cut_lineage

BLOCK = 4096
AGAINST_ORDER = 4.0
SWITCH = 1.0
FORM = 0.25
BACKWARD = 0.5

# Month names of the languages the sources write, by number.
MONTHS = {
    "jan": 1, "january": 1, "januari": 1, "januar": 1, "feb": 2, "february": 2, "februari": 2, "februar": 2,
    "mar": 3, "march": 3, "maret": 3, "mac": 3, "märz": 3, "apr": 4, "april": 4, "may": 5, "mei": 5, "mai": 5,
    "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "juli": 7, "julai": 7, "aug": 8, "august": 8,
    "agustus": 8, "agu": 8, "ogos": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10,
    "oktober": 10, "okt": 10, "nov": 11, "november": 11, "dec": 12, "december": 12, "desember": 12,
    "des": 12, "dezember": 12, "dez": 12, "disember": 12,
}
# Minutes east of UTC of zone abbreviations in their most frequent sense. A source's own zone goes first.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WIB": 420, "WITA": 480, "WIT": 540, "SGT": 480, "MYT": 480, "HKT": 480,
    "PHT": 480, "AWST": 480, "ICT": 420, "JST": 540, "KST": 540, "IST": 330, "CST": -360, "CDT": -300,
    "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540,
    "HST": -600, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}

ZONE = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|\[?[A-Za-z]+(?:/[A-Za-z_+-]+\d*)+\]?|\[?[A-Z]{2,5}\]?)?"
CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?"


def _senses(zone: str) -> dict[str, int]:
    """Abbreviation -> minutes east of UTC as the zone itself uses them (sampled by month, 1995-2040)."""
    out: dict[str, int] = {}
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except Exception:
        return out
    for year in range(1995, 2041):
        for month in range(1, 13):
            t = dt.datetime(year, month, 1, tzinfo=tz)
            if t.tzname() and t.tzname().isalpha():
                out[t.tzname()] = int(t.utcoffset().total_seconds() // 60)
    return out


@pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def zone_senses(zones: pd.Series) -> pd.Series:
    known: dict[str, dict[str, int]] = {}
    return pd.Series([known[z] if z in known else known.setdefault(z, _senses(z or "")) for z in zones])


def _int(text: Column) -> Column:
    return F.when(text != "", text).try_cast("int")


def _or0(text: Column) -> Column:
    return F.coalesce(_int(text), F.lit(0))


def _div(n: Column, by: int) -> Column:
    """Integer floor division without going through double."""
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


def _local(x: Column, months: Column) -> Column:
    """Wall clock of one candidate as microseconds, null where there is no such date or time; digits after the sixth are cut."""
    h, mi, s = _or0(x["h"]), _or0(x["mi"]), _or0(x["s"])
    late = x["half"].rlike("(?i)^p|下午|晚上|中午")
    h24 = F.when(x["half"] == "", h).when(h.between(1, 12), h % 12 + F.when(late, 12).otherwise(0))
    y = F.when(F.length(x["y"]) == 2, _int(x["y"]) + F.when(_int(x["y"]) < 70, 2000).otherwise(1900)).otherwise(_int(x["y"]))
    month = F.coalesce(_int(x["mo"]), months[F.lower(x["mo"])])
    whole = F.unix_micros(F.try_make_timestamp(y, month, _int(x["d"]), h24, mi, s, F.lit("UTC")))
    fraction = F.coalesce(F.rpad(F.substring(x["f"], 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    return F.when(h24.between(0, 23) & mi.between(0, 59) & s.between(0, 59), whole + fraction)


def _utc(local: Column, zone: Column, source_zone: Column, senses: Column) -> Column:
    """UTC microseconds of a wall clock; `zone` is what the value says without brackets, "" if nothing."""
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(zone, r"\D", ""), 4, "0")
    minutes = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    fixed = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    known = sorted(zoneinfo.available_timezones())
    named = F.when(zone == "", source_zone).when(zone.contains("/"), zone)
    shift = F.when(zone.rlike(r"^[+-]"), minutes).otherwise(F.coalesce(senses[zone], fixed[zone]))
    return F.when(
        named.isNotNull(), F.when(named.isin(known), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), named)))
    ).when(zone != "", local - shift.cast("bigint") * 60_000_000)


def interpretations(value: Column, source_zone: Column, order: Column, senses: Column) -> Column:
    """array<struct<label:string,form:string,utc_us:bigint,prior:double>> of all valid readings of `value`.

    Each pattern that fits gives a candidate of text fields; candidates become instants in one place. The
    lambdas bind every intermediate value once, so no expression is evaluated twice a row.
    """
    v = F.regexp_replace(F.trim(value), r"\s+", " ")
    fields = ("y", "mo", "d", "half", "h", "mi", "s", "f", "zone")

    def candidate(kind: str, pattern: str, names: str, label: str = "", guard: Column | None = None) -> Column:
        at = {name: F.regexp_extract(v, pattern, i + 1) for i, name in enumerate(names.split())}
        got = [at.get(k, F.lit("")).alias(k) for k in fields] + [F.lit(label).alias("label"), F.lit(kind).alias("kind")]
        fits = v.rlike(pattern) if guard is None else v.rlike(pattern) & guard
        return F.when(fits, F.struct(*got, (at["sep"] if "sep" in at else F.lit("")).alias("sep")))

    iso = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[T ]{CLOCK})? ?{ZONE}(?:\[[A-Za-z_/]+\])?$"
    compact = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?)? ?{ZONE}$"
    named = rf"^(?:\p{{L}}+, ?)?(\d{{1,2}})[ .-]+(\p{{L}}+)\.?[ .-]+(\d{{4}})(?:,? (?:pukul |jam |um |at )?{CLOCK} ?(AM|PM|am|pm)?)? ?{ZONE}$"
    han = rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日 ?(上午|下午|凌晨|早上|中午|晚上)? ?(?:{CLOCK})? ?{ZONE}$"
    numeric = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:[ ,T]+{CLOCK} ?(AM|PM|am|pm)?)? ?{ZONE}$"
    candidates = F.array(
        candidate("iso", iso, "y mo d h mi s f zone"),
        candidate("compact", compact, "y mo d h mi s f zone", guard=~v.rlike(r"^(\d{10}|\d{13}|\d{16}|\d{18,})$")),
        candidate("named", named, "d mo y h mi s f half zone"),
        candidate("han", han, "y mo d half h mi s f zone"),
        candidate("numeric", numeric, "d sep mo y h mi s f half zone", "dmy"),
        candidate("numeric", numeric, "mo sep d y h mi s f half zone", "mdy"),
    )
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    clocks = F.transform(
        F.filter(candidates, lambda x: x.isNotNull()),
        lambda x: F.struct(
            x["label"].alias("label"), x["sep"].alias("sep"), F.concat(x["kind"], x["sep"], x["label"]).alias("form"), F.regexp_replace(x["zone"], r"[\[\]]", "").alias("zone"), _local(x, months).alias("local")
        ),
    )

    def reading(x: Column) -> Column:
        # The dotted form is day-first everywhere; with other separators the source's order decides.
        wanted = F.when(x["sep"] == ".", F.lit("dmy")).otherwise(order)
        prior = F.when((x["label"] == "") | wanted.isNull() | (wanted == x["label"]), 0.0).otherwise(AGAINST_ORDER)
        return F.struct(x["label"].alias("label"), x["form"].alias("form"), _utc(x["local"], x["zone"], source_zone, senses).alias("utc_us"), prior.alias("prior"))

    n = v.try_cast("bigint")
    # Counts: seconds, milliseconds, microseconds, nanoseconds since 1970; 100 ns steps since 1601.
    counted = (
        F.when(v.rlike(r"^\d{10}$"), n * 1_000_000)
        .when(v.rlike(r"^\d{13}$"), n * 1000)
        .when(v.rlike(r"^\d{16}$"), n)
        .when(v.rlike(r"^\d{18}$"), _div(n - F.lit(116_444_736_000_000_000), 10))
        .when(v.rlike(r"^\d{19}$"), _div(n, 1000))
    )
    count = F.array(F.struct(F.lit("").alias("label"), F.lit("count").alias("form"), counted.alias("utc_us"), F.lit(0.0).alias("prior")))
    return F.filter(F.concat(count, F.transform(clocks, reading)), lambda x: x["utc_us"].isNotNull())


LABELS = ("", "dmy", "mdy")


def _states(labels: list, us: list, priors: list, forms: list) -> list[tuple[str, int, float, str]]:
    """(carried label, utc, prior, form) of one record; a reading without order carries any earlier label on."""
    return [(x, u, p, f) for lb, u, p, f in zip(labels, us, priors, forms) for x in ((lb,) if lb else LABELS)]


def _step(before: list, after: list) -> np.ndarray:
    cost = np.empty((len(before), len(after)))
    for j, (lb, u, p, f) in enumerate(after):
        for i, (la, t, _, g) in enumerate(before):
            change = (SWITCH if la and lb and la != lb else 0.0) + (FORM if f != g else 0.0)
            cost[i, j] = p + change + (BACKWARD if u < t else 0.0)
    return cost


def _carry(labels: list) -> bool:
    return not any(labels)


def _block_paths(rows: list[tuple]) -> tuple[list, list, np.ndarray, list[np.ndarray], list[list]]:
    """Min-plus matrix of a block and its back pointers. rows: (labels, us, priors, forms) in order."""
    states = [_states(*r) for r in rows]
    first = states[0]
    total = np.full((len(first), len(first)), np.inf)
    np.fill_diagonal(total, 0.0)
    back: list[np.ndarray] = []
    for k in range(1, len(states)):
        step = _step(states[k - 1], states[k])
        if _carry(rows[k][0]):  # no order of its own: only the label it came with goes on
            for j, b in enumerate(states[k]):
                for i, a in enumerate(states[k - 1]):
                    if a[0] != b[0]:
                        step[i, j] = np.inf
        all_ = total[:, :, None] + step[None, :, :]
        back.append(all_.argmin(axis=1))
        total = all_.min(axis=1)
    return first, states[-1], total, back, states


def _rows(g: pd.DataFrame) -> list[tuple]:
    return [([r["label"] for r in x], [int(r["utc_us"]) for r in x], [float(r["prior"]) for r in x], [r["form"] for r in x]) for x in g["readings"]]


def _thin(g: pd.DataFrame) -> pd.DataFrame:
    """In order, without the records that cost the same on every path: those without a day-month order between two others
    without one. A block keeps its first and last record."""
    g = g.sort_values("record_id", kind="stable")
    ordered = np.array([any(r["label"] for r in x) for x in g["readings"]])
    near = ordered.copy()
    near[1:] |= ordered[:-1]
    near[:-1] |= ordered[1:]
    near[[0, -1]] = True
    return g[near]


def _summary(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    g = _thin(g)
    first, last, total, _, _ = _block_paths(_rows(g))
    (fl, fu, fp, ff), (ll, lu, _, lf) = ([list(c) for c in zip(*s)] for s in (first, last))
    carries = _carry([r["label"] for r in g["readings"].iloc[0]])
    return pd.DataFrame(
        [(key[0], key[1], key[2], fl, fu, fp, ff, ll, lu, lf, carries, total.ravel().tolist())],
        columns=["record", "source_id", "block", "fl", "fu", "fp", "ff", "ll", "lu", "lf", "carries", "cost"],
    )


def _chain(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state of every block of a source by Viterbi over the block matrices."""
    g = g.sort_values("block")
    blocks = list(g.itertuples(index=False))
    best, trail = None, []
    for k, b in enumerate(blocks):
        nf, nl = len(b.fl), len(b.ll)
        cost = np.array(b.cost, dtype=float).reshape(nf, nl)
        if best is None:
            # at a source's start any label may be carried in, and none is the plain one
            enter = np.array([p + (0.0 if (not b.carries or lb == "") else np.inf) for p, lb in zip(b.fp, b.fl)])
            come = np.zeros(nf, dtype=int)
        else:
            prev = blocks[k - 1]
            step = _step(list(zip(prev.ll, prev.lu, [0.0] * len(prev.ll), prev.lf)), list(zip(b.fl, b.fu, b.fp, b.ff)))
            if b.carries:
                step[np.array(prev.ll, dtype=object)[:, None] != np.array(b.fl, dtype=object)[None, :]] = np.inf
            all_ = best[:, None] + step
            come, enter = all_.argmin(axis=0), all_.min(axis=0)
        through = enter[:, None] + cost
        entry = through.argmin(axis=0)
        best = through.min(axis=0)
        trail.append((come, entry))
    j, out = int(best.argmin()), []
    for k in range(len(blocks) - 1, -1, -1):
        come, entry = trail[k]
        i = int(entry[j])
        out.append((key[0], key[1], blocks[k].block, i, j))
        j = int(come[i])
    return pd.DataFrame(out, columns=["record", "source_id", "block", "entry", "exit"])


def _pick(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    g = _thin(g)
    _, _, _, back, states = _block_paths(_rows(g))
    i, j = int(g["entry"].iloc[0]), int(g["exit"].iloc[0])
    us = [0] * len(states)
    for k in range(len(states) - 1, -1, -1):
        us[k] = states[k][j][1]
        if k:
            j = int(back[k - 1][i, j])
    return pd.DataFrame({"record": g["record"], "record_id": g["record_id"], "utc_us": us})


def choose_readings(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Viterbi over the records of each (record, source_id) by record_id.

    df: record, source_id, record_id (unique in its record kind), readings. Records without a reading
    have no row; records with one reading keep it in SQL, and take part in the pass as what stands before
    and after the others.
    """
    df = df.filter(F.size("readings") > 0)
    one = df.filter(F.size("readings") == 1).select("record", "record_id", F.col("readings")[0]["utc_us"].alias("utc_us"))
    cells = df.withColumn("block", F.floor(F.col("record_id") / block).cast("bigint"))
    several = cells.withColumn("several", (F.size("readings") > 1).cast("int"))
    keys = ["record", "source_id", "block"]
    summaries = several.groupBy(*keys).applyInPandas(
        _summary,
        "record string, source_id bigint, block bigint, fl array<string>, fu array<bigint>, fp array<double>, ff array<string>,"
        " ll array<string>, lu array<bigint>, lf array<string>, carries boolean, cost array<double>",
    )
    chosen = summaries.groupBy("record", "source_id").applyInPandas(
        _chain, "record string, source_id bigint, block bigint, entry int, exit int"
    )
    open_blocks = several.groupBy(*keys).agg(F.max("several").alias("m")).filter("m = 1").drop("m")
    todo = cells.join(chosen.join(open_blocks, keys, "left_semi"), keys)
    picked = todo.groupBy(*keys).applyInPandas(_pick, "record string, record_id bigint, utc_us bigint")
    several_only = df.filter(F.size("readings") > 1).select("record", "record_id")
    return one.unionByName(picked.join(several_only, ["record", "record_id"], "left_semi"))


def normalise(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """facts: record, record_id, source_id, value; sources: as the table document_sources. Out: record, record_id, utc_us."""
    conf = sources.dropDuplicates(["id"]).select(
        F.col("id").alias("source_id"),
        F.col("configuration")["time_zone"].alias("zone"),
        F.when(F.lower(F.col("configuration")["date_order"]).isin("dmy", "mdy"), F.lower(F.col("configuration")["date_order"])).alias("date_order"),
    )
    conf = conf.withColumn("senses", zone_senses("zone"))
    readings = interpretations(F.col("value"), F.col("zone"), F.col("date_order"), F.col("senses"))
    read = (
        facts.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
        .join(conf, "source_id", "left")
        .select("record", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "record_id", readings.alias("readings"))
    )
    # four branches use the readings: they are made once
    return choose_readings(cut_lineage(read))


def library_instants(documents: DataFrame, versions: DataFrame, logs: DataFrame, sources: DataFrame) -> DataFrame:
    """The three timestamp fields of the library as one relation record, record_id, utc_us."""
    docs = documents.select(
        F.col("doc_id").alias("record_id"), F.col("document_source_id").alias("source_id"), F.col("source_last_modified_at").alias("value")
    ).dropDuplicates(["record_id"])
    owner = docs.select(F.col("record_id").alias("document_id"), "source_id")
    vers = (
        versions.select(F.col("id").alias("record_id"), "document_id", F.col("detected_at").alias("value"))
        .dropDuplicates(["record_id"])
        .join(owner, "document_id", "left")
        .select("record_id", "source_id", "value")
    )
    scans = logs.select(
        F.col("id").alias("record_id"), F.col("document_source_id").alias("source_id"), F.col("started_at").alias("value")
    ).dropDuplicates(["record_id"])
    parts = [
        x.select(F.lit(kind).alias("record"), "record_id", "source_id", "value")
        for kind, x in (("document", docs), ("version", vers), ("scan", scans))
    ]
    return normalise(reduce(DataFrame.unionByName, parts), sources)

