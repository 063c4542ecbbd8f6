"""Cutting, tiling and naming probe sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import let, third_base
from ..plans.runtime import materialize


def probe_window(pos: Column, length: int, shift: Column | int = 0) -> tuple[Column, Column, Column]:
    """(start, end, offset of the SNP) of a probe around a 1-based position; start is
    0-based, end exclusive. Odd lengths are centred; even ones have one base less
    on the left."""
    left, right = (length // 2, length // 2) if length % 2 else (length // 2 - 1, length // 2)
    start = pos - left - 1 + shift
    return start, pos + right + shift, pos - 1 - start


def check_shift(length: int, shift: int) -> None:
    """ValueError if the SNP would leave the probe."""
    most = length // 2 if length % 2 else length // 2 - 1
    if abs(shift) >= most:
        raise ValueError(f"shift must be less than {most} for length {length}")


def position_shift(where: str, length: int, offset: int | None = None) -> int:
    """The shift that puts the SNP in the centre, or to the left or right by the offset."""
    if where == "center":
        return offset or 0
    by = abs(offset) if offset else length // 4
    if where not in ("left", "right"):
        raise ValueError("where must be center, left or right")
    return by if where == "left" else -by


def probe_id(start: Column, end: Column) -> Column:
    """``chr:start-end_pos_type_ref_alt`` with a 1-based inclusive start."""
    return F.concat(F.col("chr"), F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"), F.lit("_"), F.col("pos").cast("string"), F.lit("_"), F.col("type"), F.lit("_"), F.col("ref"), F.lit("_"), F.col("alt"))


_ID = r"^(.+):(\d+)-(\d+)_(\d+)_([a-z]+)_([A-Z]+)_([A-Z]+)$"


def parse_probe_id(df: DataFrame, column: str) -> DataFrame:
    """The parts of probe ids of the above form; other ids are dropped."""
    part = lambda i, t: F.regexp_extract(column, _ID, i).try_cast(t)
    return df.filter(F.col(column).rlike(_ID)).select(column, part(1, "string").alias("chr"), part(2, "bigint").alias("start1"), part(3, "bigint").alias("end1"), part(4, "bigint").alias("pos"), part(5, "string").alias("type"), part(6, "string").alias("ref"), part(7, "string").alias("alt"))


#: Letters of a genome chunk.
CHUNK = 4096


def genome_chunks(genome: DataFrame, halo: int, size: int = CHUNK) -> DataFrame:
    """A genome (chr, seq) as (chr, _chunk, _from, _piece): chunks of ``size`` letters with
    ``halo`` letters on both sides, so that a lookup moves and scans a chunk and never a
    chromosome. ``_from`` is the 0-based place of the piece's first letter.

    A genome that is read in chunks (see ``sources.text.read_genome``: chr, from, piece)
    is cut without any row that holds a chromosome. A whole sequence in one row is cut as
    bytes, where a letter's place is known, so the time grows with its length only (letters
    other than ASCII become ``?``)."""
    if "piece" in genome.columns:
        return _rechunked(genome, halo, size)
    start = lambda c: F.greatest(c * size - halo, F.lit(0))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(s) - 1, F.lit(0)) / size).cast("int")), lambda c: F.substring(s, start(c) + 1, c * size + size + halo - start(c)).cast("string"))
    # the cut is inside the generator: the optimizer would turn a column of bytes back into one conversion a chunk
    plain = F.regexp_replace(F.upper("seq"), r"[^\x00-\x7F]", "?").cast("binary")
    t = genome.select("chr", F.posexplode(let(plain, cut)).alias("_c", "_piece"))
    return t.select("chr", F.col("_c").cast("long").alias("_chunk"), start(F.col("_c")).cast("long").alias("_from"), "_piece")


def _rechunked(pieces: DataFrame, halo: int, size: int) -> DataFrame:
    """Chunks with halos put together from pieces (chr, from, piece) of any size."""
    n = F.length("piece")
    first, last = F.greatest(F.floor((F.col("from") - halo) / size), F.lit(0)), F.floor((F.col("from") + n - 1 + halo) / size)
    t = pieces.filter(n > 0).select("chr", F.col("from").cast("long").alias("from"), F.upper("piece").alias("piece"), F.explode(F.sequence(first, last)).alias("_chunk"))
    lo, hi = F.greatest(F.col("_chunk") * size - halo, F.lit(0)), F.col("_chunk") * size + size + halo
    a = F.greatest("from", lo)
    b = F.least(F.col("from") + n, hi)
    part = t.filter(b > a).select("chr", "_chunk", a.alias("_a"), F.substr("piece", (a - F.col("from") + 1).cast("int"), (b - a).cast("int")).alias("_p"))
    got = part.groupBy("chr", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_a", "_p"))).alias("_x"))  # a chunk's letters
    own = got.filter(F.exists("_x", lambda x: x["_a"] + F.length(x["_p"]) > F.col("_chunk") * size))  # no chunk that a halo alone reaches
    return own.select("chr", "_chunk", F.element_at("_x", 1)["_a"].alias("_from"), F.array_join(F.transform("_x", lambda x: x["_p"]), "").alias("_piece"))


def genome_sizes(genome: DataFrame) -> DataFrame:
    """(chr, _len) of a genome in whole sequences or in pieces."""
    if "piece" in genome.columns:
        return genome.groupBy("chr").agg(F.max(F.col("from") + F.length("piece")).cast("long").alias("_len"))
    return genome.select("chr", F.length("seq").cast("long").alias("_len"))


def _on_genome(snps: DataFrame, genome: DataFrame, halo: int) -> tuple[DataFrame, object]:
    """SNPs with their chromosome's length (``_len``, null if unknown) and chunk, and a
    function (0-based start, length) -> letters. The start must lie within halo of pos."""
    sizes = genome_sizes(genome)
    keyed = snps.withColumn("_chunk", F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / CHUNK))
    j = keyed.join(sizes, "chr", "left").join(genome_chunks(genome, halo), ["chr", "_chunk"], "left")
    return j, lambda start, n: F.substr(F.col("_piece"), (start - F.col("_from") + 1).cast("int"), F.lit(n) if isinstance(n, int) else n.cast("int"))


def cut_probes(snps: DataFrame, genome: DataFrame, length: int = 81, shift: int = 0, replace_snp: bool = False) -> DataFrame:
    """SNP-centred probes: snps (chr, pos, type, ref, alt) with ``start``, ``end``,
    ``probe_id``, ``seq`` and ``reject``: null, or the first of no_chr, before_start,
    after_end, ref_mismatch. With ``replace_snp`` the SNP's base is replaced by one
    that is neither allele (the same one on every run). SNPs meet chunks of the
    genome by (chr, chunk), whatever the chromosomes' sizes."""
    check_shift(length, shift)
    start, end, off = probe_window(F.col("pos"), length, shift)
    j, letters = _on_genome(snps, genome, 2 * length)
    j = j.withColumn("start", start).withColumn("end", end)
    raw, base = letters(F.col("start"), length), letters(F.col("pos") - 1, 1)
    reject = F.when(F.col("_len").isNull(), "no_chr").when(F.col("start") < 0, "before_start").when(F.col("end") > F.col("_len"), "after_end").when(base != F.upper("ref"), "ref_mismatch")
    j = j.withColumn("reject", reject).withColumn("probe_id", probe_id(F.col("start"), F.col("end")))
    seq = F.overlay(raw, third_base(F.col("ref"), F.col("alt"), F.col("probe_id")), (off + 1).cast("int")) if replace_snp else raw
    return j.withColumn("seq", F.when(F.col("reject").isNull(), seq)).drop("_chunk", "_len", "_from", "_piece")


def tile_shifts(snps: DataFrame, length: int = 81, offset: int = 15) -> DataFrame:
    """Three probes per SNP: centred (C), moved by the offset (L) and by minus it (R)."""
    check_shift(length, offset)
    shifts = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("shift")) for t, s in (("C", 0), ("L", offset), ("R", -offset))])
    j = snps.withColumn("_t", F.explode(shifts)).select(*snps.columns, "_t.tag", "_t.shift")
    start, end, _ = probe_window(F.col("pos"), length, F.col("shift"))
    return j.withColumn("start", start).withColumn("end", end).withColumn("probe_id", F.concat(probe_id(F.col("start"), F.col("end")), F.lit("_"), F.col("tag")))


def parse_positions(text: str, length: int) -> list[tuple[str, int]]:
    """``center``, ``left``, ``right`` or signed integers, comma-separated -> (name, shift).
    A positive offset lies to the left of the centre, a negative one to the right."""
    out = []
    for i, x in enumerate(p.strip() for p in text.split(",") if p.strip()):
        if x == "center":
            out.append(("C", 0))
        elif x in ("left", "right"):
            out.append((f"{x[0].upper()}{i}", position_shift(x, length)))
        else:
            k = int(x)
            out.append(("C" if k == 0 else f"{'L' if k > 0 else 'R'}{i}", k))
        check_shift(length, out[-1][1])
    return out


def tile_alleles(snps: DataFrame, positions: str, length: int = 81) -> DataFrame:
    """For every SNP one probe per position and allele (REF and ALT): chr, pos,
    ``place``, ``allele``, ``base``, start, end, probe_id."""
    places = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(s).alias("shift")) for n, s in parse_positions(positions, length)])
    alleles = F.array(F.struct(F.lit("REF").alias("allele"), F.col("ref").alias("base")), F.struct(F.lit("ALT").alias("allele"), F.col("alt").alias("base")))
    j = snps.withColumn("_p", F.explode(places)).withColumn("_a", F.explode(alleles)).select("chr", "pos", "type", "ref", "alt", "_p.*", "_a.*")
    start, end, _ = probe_window(F.col("pos"), length, F.col("shift"))
    j = j.withColumn("start", start).withColumn("end", end)
    return j.select("chr", "pos", "place", "allele", "base", "start", "end", F.concat(probe_id(F.col("start"), F.col("end")), F.lit("_"), F.col("place"), F.lit("_"), F.col("allele")).alias("probe_id"))


def flanked(df: DataFrame, genome: DataFrame, length: int = 81, clip: bool = False) -> DataFrame:
    """The sequence around each SNP as left flank + ref + right flank; probes that the
    chromosome's ends cut short are dropped, or kept short with ``clip``."""
    start, end, _ = probe_window(F.col("pos"), length)
    j, letters = _on_genome(df, genome, 2 * length)
    s, e = F.greatest(start, F.lit(0)), F.least(end, F.col("_len"))
    seq = F.concat(letters(s, F.col("pos") - 1 - s), F.upper("ref"), letters(F.col("pos"), F.greatest(e - F.col("pos"), F.lit(0))))
    out = j.filter((F.col("pos") >= 1) & (F.col("pos") <= F.col("_len"))).withColumn("seq", seq).drop("_chunk", "_len", "_from", "_piece")
    return out if clip else out.filter(F.length("seq") == length)


def add_adapters(seq: Column, five: str = "", three: str = "") -> Column:
    """Adapters in front of and behind a sequence; they may hold A, T, C, G, N only."""
    for a in (five, three):
        if a.upper().strip("ATCGN"):
            raise ValueError(f"adapter {a} has letters other than A, T, C, G, N")
    return F.concat(F.lit(five.upper()), seq, F.lit(three.upper()))


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Adds a gapless index from 0 in the given order, without one task holding all rows:
    range partitions are numbered inside and shifted by the sizes before them.
    ``order`` must be total for the index to be the same on every run. Runs a job."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = cut.df.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # at most `parts` rows
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order)
    return cut.df.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.row_number().over(w) - 1).drop("_part", "_before")


def rename_by_prefix(df: DataFrame, order: list[str], prefix: str, start: int = 1, width: int = 4) -> DataFrame:
    """Adds ``new_id``: prefix, underscore, index padded to the larger of width and its longest number."""
    n = dense_index(df, order, "_i")
    digits = F.greatest(F.lit(width), F.length((F.lit(start) + df.count()).cast("string")))
    number = (F.col("_i") + start).cast("string")
    return n.withColumn("new_id", F.concat(F.lit(prefix + "_"), F.lpad(number, F.greatest(digits, F.length(number)), F.lit("0")))).drop("_i")


def rename_by_map(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Adds ``new_id`` from mapping (old_id, new_id); unmapped ids stay, ``mapped`` says
    which. Of several new ids of one old id the smallest holds."""
    one = mapping.filter("old_id is not null").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    return df.join(one, df[column] == one["old_id"], "left").withColumn("mapped", F.col("old_id").isNotNull()).withColumn("new_id", F.coalesce("new_id", column)).drop("old_id")


def haplotype_id(column: Column) -> tuple[Column, Column]:
    """(gene, allele number) of ids like ``GENE_2``; the whole id and null otherwise."""
    form = r"^(.*)_([0-9]+)$"
    return F.when(column.rlike(form), F.regexp_extract(column, form, 1)).otherwise(column), F.when(column.rlike(form), F.regexp_extract(column, form, 2))


def snp_to_bed(df: DataFrame) -> DataFrame:
    """SNPs as 0-based half-open intervals."""
    return df.select("chr", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))


def tile_starts(n: Column, length: int, step: int) -> Column:
    """0-based starts 0, step, …, and a last one that ends at n; null if n < length."""
    return F.when(n >= length, F.array_distinct(F.concat(F.sequence(F.lit(0), n - length, F.lit(step)), F.array(n - length))))


def tile_regions(df: DataFrame, seq: str = "seq", length: int = 81, step: int = 30) -> DataFrame:
    """Windows of each sequence that hold no N: all columns but seq, ``tile_no`` (from 1,
    windows with N counted), ``start1``, ``end1`` (1-based inclusive), ``tile``.
    Sequences shorter than a window give none."""
    up = F.upper(F.col(seq))
    t = df.select(*[c for c in df.columns if c != seq], up.alias("_s"), F.posexplode(tile_starts(F.length(up), length, step)).alias("_i", "_at"))
    keep = [c for c in df.columns if c != seq]
    out = t.select(*keep, (F.col("_i") + 1).alias("tile_no"), (F.col("_at") + 1).alias("start1"), (F.col("_at") + length).alias("end1"), F.substr("_s", F.col("_at") + 1, F.lit(length)).alias("tile"))
    return out.filter(~F.contains("tile", F.lit("N")))


def tile_sequences(df: DataFrame, key: str = "id", seq: str = "seq", length: int = 81, step: int = 30) -> DataFrame:
    """Windows of each sequence: ``tile_id`` = ``{id}:{start}-{end}_tile{n}``, ``tile``; a
    shorter sequence comes out whole as ``{id}_tile1``."""
    n = F.length(seq)
    starts = F.coalesce(tile_starts(n, length, step), F.array(F.lit(0)))
    t = df.filter(F.col(seq).isNotNull()).select(key, seq, F.posexplode(starts).alias("_i", "_at"))
    short = F.length(seq) < length
    name = F.concat(F.col(key), F.lit(":"), (F.col("_at")).cast("string"), F.lit("-"), (F.col("_at") + length).cast("string"), F.lit("_tile"), (F.col("_i") + 1).cast("string"))
    return t.select(key, F.when(short, F.concat(F.col(key), F.lit("_tile1"))).otherwise(name).alias("tile_id"), F.substr(seq, F.col("_at") + 1, F.lit(length)).alias("tile"))
