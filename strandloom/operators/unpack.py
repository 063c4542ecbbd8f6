"""Several values packed in one field: one row per value, with its position.

Method: every field is cut into segments (a run of ordinary characters, or one
special character); the *skeleton* of a field is that segmentation with every
run masked by ``w``.  Splitting rules are resolved once per distinct skeleton,
on the skeleton text alone, and are then joined back (broadcast if the measured
size of the rule table allows it) and applied to the segments by position.
Everything stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import fresh, lookup_join, materialize, require

#: Marks between values, besides whitespace.
SEPARATORS = ",;|"
#: Marks around a whole list.
ENCLOSERS = "[]{}()"

_SPECIAL = r"(?U)[\s,;|\[\]{}()\"']"
_ORDINARY_RUN = r"(?U)[^\s,;|\[\]{}()\"']+"
_BETWEEN = r"[\s,;|\[\]{}()]+"
#: Ordered: gaps, a quoted value (doubled mark inside), an unquoted value. Covers every skeleton.
_TOKEN = r"(?U)" + _BETWEEN + r"|\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|[^\s,;|\[\]{}()]+"


def split_packed(df: DataFrame, field: str, key: list[str], value: str = "value", number: str = "value_no") -> DataFrame:
    """One row per non-empty value packed in ``field``: key columns, ``number``
    (from 1, in order), ``value``.

    Values are separated by any run of whitespace, comma, semicolon or bar, also
    mixed within one field; square, curly and round brackets outside quotes only
    enclose.  A single or double quote opens a quoted value only where a value
    begins; inside, the doubled mark stands for itself and separators are
    ordinary.  A quote that is never closed is an ordinary character.

    Nulls, empty fields and fields of marks only give no rows.  A value that is
    blank after quotes and outer blanks are removed counts as empty.  Repeated
    rows of one key with the same field count once; rows of one key with
    different fields are all split, each numbered from 1.  Other columns of
    ``df`` are ignored.  Runs one job to resolve the rules.
    """
    require(df, field, *key)
    packed, segs, skel, rule = (fresh(df, x) for x in ("packed", "segs", "skeleton", "rule"))
    rows = (
        df.filter(F.col(field).isNotNull())
        .select(*key, F.col(field).cast("string").alias(packed))
        .distinct()
        .withColumn(skel, F.regexp_replace(packed, _ORDINARY_RUN, "w"))
    )
    rules = materialize(skeleton_rules(rows.select(skel).distinct(), skel, rule))
    joined = lookup_join(rows, rules, [skel])
    parts = joined.withColumn(segs, F.regexp_extract_all(packed, F.lit(f"{_ORDINARY_RUN}|{_SPECIAL}"), F.lit(0)))
    raw = F.transform(F.col(rule), lambda r: F.struct(F.array_join(F.slice(F.col(segs), r["at"], r["n"]), "").alias("text"), r["quote"].alias("quote")))
    text = F.transform(raw, lambda x: F.trim(F.when(x["quote"] == "", x["text"]).otherwise(F.replace(x["text"], F.concat(x["quote"], x["quote"]), x["quote"]))))
    kept = F.filter(text, lambda x: x != "")
    out = parts.select(*key, F.posexplode(kept).alias("_p", value))
    return out.select(*key, (F.col("_p") + 1).cast("int").alias(number), value)


def skeleton_rules(skeletons: DataFrame, skel: str, rule: str) -> DataFrame:
    """For each skeleton the places of its values: array of (at, n, quote), ``at``
    counting segments from 1. Each skeleton character is one segment."""
    tokens = F.regexp_extract_all(F.col(skel), F.lit(_TOKEN), F.lit(0))
    placed = F.aggregate(
        tokens,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,tok:string>>").alias("out")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t)).alias("at"),
            F.when(t.rlike(r"(?U)^" + _BETWEEN + "$"), s["out"]).otherwise(F.array_append(s["out"], F.struct(s["at"].alias("at"), t.alias("tok")))).alias("out"),
        ),
    )["out"]

    def place(p):
        mark = F.substring(p["tok"], 1, 1)
        quoted = (F.length(p["tok"]) >= 2) & mark.isin('"', "'") & (F.substring(p["tok"], -1, 1) == mark) & p["tok"].rlike("(?s)^(\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*')$")
        inner = F.when(quoted, 1).otherwise(0)
        return F.struct((p["at"] + inner).alias("at"), (F.length(p["tok"]) - 2 * inner).alias("n"), F.when(quoted, mark).otherwise("").alias("quote"))

    return skeletons.select(skel, F.transform(placed, place).alias(rule))
