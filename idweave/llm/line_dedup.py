"""Fuzzy line de-duplication by MinHash, with DataFrame functions only.

Similarity is the Jaccard similarity of the sets of all five-character shingles, and these very sets are signed. A
line's shingles are dealt by hash into ``PARTS`` parts, and MinHash values of a part, ``ROWS`` to a band, are its bands
(one permutation hashing); lines of few shingles, whose parts would hold next to none, sign all of them for every part.
Lines that share a band are candidates, verified by exact Jaccard similarity, and verified links are joined by
distributed union-find; the first line of a component stays. A bucket is never expanded into all its pairs: its lines
are held against two pivots first, and only lines that are not in the pivot's component are held against the rest, a
bounded number of pivots a round, behind bit sketches that never reject a true pair.
"""

from __future__ import annotations

import random
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idweave.functions.binding import bind
from idweave.llm.common import Staged, components, decided, noting

BANDS, PARTS, ROWS = 16, 8, 6  #: a pair of similarity s shares no band with a probability of (1 - s ** ROWS) ** BANDS: 0.8 % at 0.8, 0.04 % at 0.85
BROADCAST_KEYS = 2_000_000  #: keys of lines that are fetched are broadcast up to this count (16 MB) and shuffled beyond it
SIGNED = 5  #: characters of a shingle
KEY_BITS = 40  #: of a band's key: rows of bands are most of what is dealt; bands that share a key by chance are candidates that verification rejects
WORDS = 8  #: of 64 bits in a line's sketch
WIDE_WORDS, LONG = 32, 96  #: of 64 bits in the larger sketch of a line of more than so many different shingles, read where pivots failed to join a bucket
PIVOTS = 512  #: lines of a bucket that are held against all of it in one round
SHORT = 64  #: shingles of a line up to which all its links come from bands that each sign all its shingles
SAMPLED, HOT, MOST_HOT = 256, 64, 10_000  #: one line in so many tells which buckets are hot; this many of them in one mark it; hot buckets split at most
CELLS = 1 << 19  #: of 64 bits that tell all tasks which texts may lose lines: 12 MB at most
_dealt = random.Random(8)
MASKS = [_dealt.getrandbits(64) - (1 << 63) for _ in range(BANDS // PARTS * ROWS)]


def key_of(line: Column) -> Column:
    """A 64-bit key of a line; two different lines among n share one with a probability of about n * n / 2 ** 65."""
    return F.xxhash64(line)


def lines_of(df: DataFrame, id: str, text: str) -> DataFrame:
    """A row for each line with anything but white space: id, line_no, line, k."""
    rows = df.select(F.col(id).alias("id"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("line_no", "line"))
    # nearly every line begins with something else than white space, which needs no pattern
    return rows.where((F.ascii("line") > 32) | F.col("line").rlike(r"\S")).withColumn("k", key_of(F.col("line")))


def shingle_hashes(line: Column) -> Column:
    """Hashes of all runs of five characters, as ``shingle_rows`` makes them; a shorter line is one shingle."""
    last = lambda wide: F.greatest((F.octet_length(wide) / 4).cast("int") - SIGNED, F.lit(0))
    return bind(F.encode(line, "UTF-32"), lambda wide: F.transform(F.sequence(F.lit(0), last(wide)), lambda i: F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(4 * SIGNED)))))


def shingle_rows(lines: DataFrame) -> DataFrame:
    """k and h of every shingle of ``lines`` (k, line), repeated ones too.

    UTF-32 has four bytes a character, so a shingle is cut out in one step; rows instead of arrays stay in compiled code.
    """
    wide = lines.select("k", F.encode("line", "UTF-32").alias("wide")).withColumn("last", F.greatest((F.octet_length("wide") / 4).cast("int") - SIGNED, F.lit(0)))
    stretch = wide.select("k", "wide", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(4096))).alias("at"))
    every = stretch.select("k", "wide", F.explode(F.sequence("at", F.least(F.col("at") + 4095, "last"))).alias("at"))
    return every.select("k", F.xxhash64(F.substring("wide", F.col("at") * 4 + 1, F.lit(4 * SIGNED))).alias("h"))


def enough(both: Column, n_a: Column, n_b: Column, least: float) -> Column:
    """Whether sets of n_a and n_b elements that share ``both`` have that Jaccard similarity."""
    return both * (1 + least) >= F.lit(least) * (n_a + n_b) - 1e-9


def alike(a: Column, b: Column, n_a: Column, n_b: Column, least: float) -> Column:
    return enough(F.size(F.array_intersect(shingle_hashes(a), shingle_hashes(b))), n_a, n_b, least)


def sketches(lines: DataFrame) -> DataFrame:
    """lines (k, line; dealt by k) with n, the number of different shingles, each of which sets one bit, and the words of two bit sets.

    The small set's word i is what words i, i + WORDS, ... of the larger one, v, hold together; only lines of many shingles keep v.
    """
    word = F.pmod(F.shiftright("h", 6), F.lit(WIDE_WORDS)).cast("int")
    bits = shingle_rows(lines).groupBy("k", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("bits"))
    own = bits.groupBy("k").agg(*[F.bit_or(F.when(F.col("word") == i, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"v{i}") for i in range(WIDE_WORDS)])
    small = [reduce(Column.bitwiseOR, [F.col(f"v{k}") for k in range(i, WIDE_WORDS, WORDS)]).alias(f"w{i}") for i in range(WORDS)]
    wide = [F.when(F.col("n") > LONG, F.col(f"v{i}")).alias(f"v{i}") for i in range(WIDE_WORDS)]
    return lines.withColumn("n", F.size(F.array_distinct(shingle_hashes(F.col("line"))))).join(own.hint("merge"), "k").select("k", "line", "n", *small, *wide)


def may_be_alike(least: float, wide: bool = False) -> Column:
    """No false verdict against a pair: each bit that only one line has stands for a shingle that only it has.

    With ``wide`` the larger bit sets decide where both lines have one.
    """

    def bound(word: str, words: int) -> Column:
        only = lambda x, y: sum((F.bit_count(F.col(f"{x}{word}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{word}{i}")))) for i in range(1, words)), F.bit_count(F.col(f"{x}{word}0").bitwiseAND(F.bitwise_not(F.col(f"{y}{word}0")))))
        most = F.least(F.col("p_n") - only("p_", ""), F.col("n") - only("", "p_"))
        return enough(most, F.col("p_n"), F.col("n"), least)

    near = enough(F.least("p_n", "n"), F.col("p_n"), F.col("n"), least) & bound("w", WORDS)
    return near & F.coalesce(bound("v", WIDE_WORDS), F.lit(True)) if wide else near


def signed(shingles: DataFrame, kind: int) -> DataFrame:
    """k and b of every band of shingles (k, part, h); all rows of k are in one partition.

    The element nearest to a mask, by exclusive or, is a MinHash value; each mask sees the hash turned by other bits, so
    that few elements are ordered anew as well.
    """
    turned = lambda i: F.col("h") if not i else F.shiftleft("h", 5 * i).bitwiseOR(F.shiftrightunsigned("h", 64 - 5 * i))
    least = shingles.groupBy("k", "part").agg(*[F.min(turned(i).bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(MASKS)])
    key = lambda i: F.xxhash64(F.lit(kind), F.lit(i), "part", *[f"m{i + r}" for r in range(ROWS)])
    bands = [F.shiftrightunsigned(key(i), 64 - KEY_BITS) for i in range(0, len(MASKS), ROWS)]
    return least.select("k", F.explode(F.array(*bands)).alias("b"))


def banded(lines: DataFrame, least: float) -> DataFrame:
    """k and b of every band of the different lines among lines (k, line).

    A line of n shingles links with none of more than n / least. So lines of up to SHORT / least different shingles sign
    all of them for every part, each part with a hash of its own, and lines of SHORT shingles or more deal theirs among the parts.
    """
    widest = int(SHORT / least + 1e-6)
    lines = lines.select("k", "line").dropDuplicates(["k"])  # dealt once for both kinds
    # the beginning of a long line tells in nearly all cases that its shingles are too many
    few = lambda line: F.size(F.array_distinct(shingle_hashes(line))) <= widest
    short = lines.where(F.when(F.char_length("line") < widest + SIGNED, True).otherwise(few(F.substring("line", 1, widest + 24)) & few(F.col("line"))))
    every = shingle_rows(short).select("k", "h", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")).select("k", "part", F.xxhash64("h", "part").alias("h"))
    dealt = shingle_rows(lines.where(F.char_length("line") >= SHORT + SIGNED - 1)).select("k", F.pmod(F.shiftright("h", 3), F.lit(PARTS)).cast("int").alias("part"), F.xxhash64("h").alias("h"))
    return signed(every, 0).unionByName(signed(dealt, 1))


def buckets(lines: DataFrame, least: float) -> DataFrame:
    """Buckets of two lines or more: b, k.

    A sample of the lines tells which buckets are hot. Their rows are all kept, so no task ever gathers them; the others
    meet in windows of two numbers a row, which spill.
    """
    sampled = Staged(lines.where(F.pmod(F.col("k"), F.lit(SAMPLED)) == 0).select("k", "line"), "sampled").df
    hot = Staged(banded(sampled, least).groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "b").limit(MOST_HOT).select("b"), "hot").df
    rows = banded(lines, least).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "b", "left")
    part = F.when(F.col("hot"), 1 + F.xxhash64("k").bitwiseAND(4095)).otherwise(0).cast("int")
    own = Window.partitionBy("b", "part")
    rows = rows.select(part.alias("part"), "k", "b").withColumn("low", F.min("k").over(own)).withColumn("high", F.max("k").over(own))
    return rows.where("part > 0 or low <> high").select("b", "k")


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose k is one of ``keys``, which are told to all tasks up to a count of BROADCAST_KEYS and shuffled beyond it."""
    keys = Staged(keys.select("k").distinct(), "keys").df
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), "k", "left_semi")


def line_components(lines: DataFrame, least: float) -> DataFrame:
    """Lines linked with another: node, component, by key."""
    with noting() as used:
        joined = _line_components(lines, least)
    for table in used:
        if table.df is not joined:
            table.drop()
    return joined


def _line_components(lines: DataFrame, least: float) -> DataFrame:
    member = Staged(buckets(lines, least), "members").df
    own = Staged(sketches(among(lines.select("k", "line"), member).groupBy("k").agg(F.first("line").alias("line"))), "sketches").df
    text, sketch, wide = own.select("k", "line"), own.select("k", "n", *[f"w{i}" for i in range(WORDS)]), own.drop("line")
    as_pivot = lambda df: df.select(*[c if c == "b" else F.col(c).alias("p" if c == "k" else f"p_{c}") for c in df.columns])
    own_buckets = member.groupBy("k").agg(F.array_sort(F.collect_list("b")).alias("bs"))  # 2 * BANDS at most
    # two lines of each bucket first: the same one wherever it is, and one dealt by the bucket
    first = member.groupBy("b").agg(F.array(F.min("k"), F.min_by("k", F.xxhash64("k", "b"))).alias("p")).select("b", F.explode("p").alias("k"))
    pairs = as_pivot(first).join(member, "b").where("p <> k").select(F.least("p", "k").alias("p"), F.greatest("p", "k").alias("k")).distinct()
    near = as_pivot(sketch).join(pairs, "p").join(sketch, "k").where(may_be_alike(least)).select("p", "k", "p_n", "n")
    joined = None
    while True:
        near = Staged(near, "near").df
        # only lines of pairs that are left are dealt by their key
        p_text, k_text = among(text, near.select(F.col("p").alias("k"))).toDF("p", "p_line"), among(text, near)
        checked = near.join(p_text, "p").join(k_text, "k").where(alike(F.col("p_line"), F.col("line"), F.col("p_n"), F.col("n"), least))
        links = checked.select(F.col("p").alias("src"), F.col("k").alias("dst"))
        joined = components(links if joined is None else links.unionByName(joined.toDF("src", "dst")))
        open_ = member.join(joined.withColumnRenamed("node", "k"), "k", "left").select("b", "k", F.coalesce("component", "k").alias("c"))
        ends = open_.groupBy("b").agg(F.min_by("c", "k").alias("main"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("b", "main")
        open_ = Staged(open_.join(ends, "b"), "open").df  # of the buckets that hold lines of several components
        if open_.isEmpty():
            return joined
        outside = open_.where("c <> main")
        chosen = outside.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("k"))).where(F.col("r") <= PIVOTS)
        chosen = Staged(chosen.join(outside.groupBy("b").agg(F.count("*").alias("size")), "b").select("b", "k", "c", "size"), "pivots").df
        rest = open_.join(chosen.where(F.col("size") > PIVOTS).select("b").distinct(), "b", "left_semi")
        more = wide.join(own_buckets, "k")
        now = open_.select("b", "k", "c").join(more, "k")
        # a pair that shares several buckets is made in the first of them only
        apart = (F.col("c") != F.col("p_c")) & (F.col("b") == F.element_at(F.array_intersect("bs", "p_bs"), 1)) & may_be_alike(least, wide=True)
        near = as_pivot(chosen.drop("size").join(more, "k")).join(now, "b").where(apart)
        near = near.select(F.least("p", "k").alias("p"), F.greatest("p", "k").alias("k"), F.when(F.col("p") < F.col("k"), F.col("p_n")).otherwise(F.col("n")).alias("p_n"), F.when(F.col("p") < F.col("k"), F.col("n")).otherwise(F.col("p_n")).alias("n")).distinct()
        member = Staged(rest.join(chosen.select("b", "k"), ["b", "k"], "left_anti").select("b", "k"), "members").df


def mark_lines(df: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """A row for each line with a character other than white space: id, line_no, first_id, first_line_no, kept.

    Lines end at "\\n" and are numbered from 0. Two lines are linked when they are equal or the Jaccard similarity of their
    sets of five-character shingles is ``least`` or more; a line of up to five characters is its own single shingle.
    first_id and first_line_no name the first line, by id and number, of the line's component, which alone is kept. Null
    and empty texts and blank lines give no rows. An id names one text; repeated rows stay repeated. Other columns of df
    are dropped, whatever their names.
    """
    lines = lines_of(df, id, text)
    joined = line_components(lines, least)
    own = lines.groupBy("k").agg(F.min(F.struct("id", "line_no")).alias("first"))
    own = own.join(joined.withColumnRenamed("node", "k"), "k", "left").select("k", "first", F.coalesce("component", "k").alias("component"))
    own = Staged(own, "firsts").df
    first = own.groupBy("component").agg(F.min("first").alias("first"))
    line_first = own.select("k", "component").join(first, "component").select("k", "first")
    out = lines.select("id", "line_no", "k").join(line_first, "k")
    kept = (F.col("id") == F.col("first.id")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select(F.col("id").alias(id), F.col("line_no").cast("long").alias("line_no"), F.col("first.id").alias("first_id"), F.col("first.line_no").cast("long").alias("first_line_no"), kept.alias("kept"))


def drop_lines(df: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """df with each text's repeated lines taken out; rows, other columns (of any names), blank lines and lines' order stay.

    Null texts stay null. Rows with a null id keep their text.
    """
    at, lines, cell, bits = (f"{stem}_{uuid.uuid4().hex}" for stem in ("at", "lines", "cell", "bits"))
    listed = lambda: mark_lines(df.where(F.col(id).isNotNull()), id, text, least).where("not kept").groupBy(id).agg(F.collect_set("line_no").alias("gone")).toDF(at, lines)
    gone = decided(listed, "gone")
    # texts that lose nothing, by the hash of their id, are not dealt; the cells' false hits only deal more
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * CELLS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(63).cast("int"))
    cells = gone.groupBy(F.shiftright(place(F.col(at)), 6).alias(cell)).agg(F.bit_or(bit(F.col(at))).alias(bits))
    told = df.withColumn(cell, F.shiftright(place(F.col(id)), 6)).join(F.broadcast(cells), cell, "left")
    hit = F.col(bits).isNotNull() & (F.col(bits).bitwiseAND(bit(F.col(id))) != 0)
    rest = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(lines, i.cast("long")))
    joined = told.where(hit).join(gone, F.col(id) == F.col(at), "left")
    cut = joined.withColumn(text, F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))).select(*df.columns)
    return told.where(~hit).select(*df.columns).union(cut)
