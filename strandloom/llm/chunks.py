"""Splitting oversized items at natural boundaries, with overlap.

``split_text``: one bounded-quantifier regular expression per item walks the
text.  Its ordered alternatives are: all of the rest, if it fits; up to the last
boundary within reach (strongest boundary first); as many characters as the
limit allows.  Matches don't overlap; the overlap is looked back from the end of
the piece before, so offsets are running sums of match lengths, and a piece after
the first has that much less to consume.

``split_extent``: the same rule for items that have a length and boundary
offsets but no text, with SQL array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = "array<struct<piece_no:int,start_off:int,end_off:int>>"


def piece_pattern(limit: int, overlap: int, boundaries: list[str]) -> str:
    """The walking pattern. ``boundaries``: zero-width patterns, strongest first."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    reach = limit - overlap
    first = "".join(rf"\A[\s\S]{{{overlap + 1},{limit}}}{b}|" for b in boundaries)
    later = "".join(rf"[\s\S]{{1,{reach}}}{b}|" for b in boundaries)
    return rf"\A[\s\S]{{1,{limit}}}+\z|{first}\A[\s\S]{{{limit}}}|[\s\S]{{1,{reach}}}+\z|{later}[\s\S]{{{reach}}}"


def split_text(text: Column, limit: int, overlap: int, boundaries: list[str]) -> Column:
    """Pieces of ``text`` as an array of (piece_no, start_off, end_off), ends
    exclusive; null for null, empty for the empty text, one piece for a text
    within the limit. Consecutive pieces overlap by ``overlap`` characters, and
    concatenating them without the overlaps gives the text back."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(piece_pattern(limit, overlap, boundaries)), F.lit(0)), lambda p: F.length(p))

    def walk(n):
        both = F.zip_with(running(n), n, lambda end, size: F.struct(F.greatest(end - size - overlap, F.lit(0)).alias("start"), end.alias("end")))
        return F.transform(both, lambda x, i: F.struct((i + 1).alias("piece_no"), x["start"].alias("start_off"), x["end"].alias("end_off")))

    return F.when(text.isNotNull(), _let(lengths, walk))


def running(numbers: Column) -> Column:
    """Running sums of an array of integers, with blocks of about the square root of its length:
    sums of blocks first, then each number adds the part of its own block."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def by_block(b):
        sums = F.transform(F.sequence(F.lit(0), F.size(numbers) - 1, b), lambda first: add(F.slice(numbers, first + 1, b)))
        before = _let(sums, lambda t: F.transform(t, lambda _, j: add(F.slice(t, F.lit(1), j))))
        block = lambda i: F.floor(i / b).cast("int")
        return _let(before, lambda q: F.transform(numbers, lambda _, i: F.element_at(q, block(i) + 1) + add(F.slice(numbers, block(i) * b + 1, i % b + 1))))

    return F.when(F.size(numbers) > 0, _let(F.ceil(F.sqrt(F.size(numbers))).cast("int"), by_block)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with value evaluated once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_extent(length: Column, ends: Column, limit: int, overlap: int) -> Column:
    """Pieces of an extent of ``length``, cut at the offsets in ``ends`` (any order,
    repeats, nulls and offsets outside are ignored; null means none); same result
    type as ``split_text``. Null or negative length gives null, 0 an empty array."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    inside = F.array_sort(F.filter(F.array_distinct(F.coalesce(ends, F.array().cast("array<int>"))), lambda e: e.isNotNull() & (e > 0) & (e < length)))
    step, none = limit - overlap, F.array().cast("array<struct<start:int,end:int>>")
    piece = lambda a, e: F.struct(a.cast("int").alias("start"), e.cast("int").alias("end"))

    def meet(s, cut):
        """The next boundary (or the end): what must be cut before it is cut, and it is the best place for the next cut if that is in reach."""
        at, best = s["at"], s["best"]
        at_best = (cut > at + limit) & (best > 0)

        def then(start):
            forced = F.greatest(F.ceil((cut - start - limit) / F.lit(step)), F.lit(0)).cast("int")

            def go(k):
                now = (start + k * step).cast("int")
                one = F.when(at_best, F.array(piece(at, best))).otherwise(none)
                more = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda j: piece(start + j * step, start + j * step + limit))).otherwise(none)
                out = F.when(at_best | (k > 0), F.concat(s["out"], one, more)).otherwise(s["out"])
                return F.struct(now.alias("at"), F.when(cut > now + overlap, cut).otherwise(best).cast("int").alias("best"), out.alias("out"))

            return _let(forced, go)

        return _let(F.when(at_best, best - overlap).otherwise(at).cast("int"), then)

    def number(s):
        whole = F.concat(s["out"], F.array(piece(s["at"], length)))
        return F.transform(whole, lambda x, i: F.struct((i + 1).alias("piece_no"), x["start"].alias("start_off"), x["end"].alias("end_off")))

    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("best"), none.alias("out"))
    # one step a boundary, however many pieces lie before it
    pieces = _let(F.aggregate(F.array_append(inside, length.cast("int")), start, meet), number)
    return F.when(length > 0, pieces).when(length == 0, F.array().cast(PIECE))


def explode_pieces(df: DataFrame, pieces: str) -> DataFrame:
    """One row per piece, with the other columns of ``df``."""
    return df.select(*[c for c in df.columns if c != pieces], F.explode(pieces).alias("_p")).select(*[c for c in df.columns if c != pieces], "_p.piece_no", "_p.start_off", "_p.end_off")
