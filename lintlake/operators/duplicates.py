"""Duplicated blocks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.patterns import SPACE
from lintlake.functions.sqltext import let, quote
from lintlake.support import explode_once, spread, stored


def duplicate_blocks(files: DataFrame, k: int = 6, salts: int = 16) -> DataFrame:
    """Every place of every block of `k` consecutive lines that occurs at least twice.

    Lines are compared with their whitespace normalised, and a block of blank lines is none.  Blocks are grouped by
    two hashes, 96 bits in all, and a block found many times stays one row per
    place.  Such a block would put all its places into one task of the join, so
    places are spread over `salts` parts of the key and the few block counts are
    repeated for each part.
    """
    # Runs of whitespace within a line become one blank, in one go over the text.
    squeezed = f"regexp_replace(code, {quote(f'(?U){SPACE[:-1]}&&[^' + chr(10) + ']]+')}, ' ')"
    lines = f"transform(split({squeezed}, chr(10), -1), text -> trim(text))"
    normal = spread(files.select("file", "code")).select("file", F.expr(lines).alias("lines"))
    place = let(
        f"array_join(slice(lines, at, {k}), chr(10))",
        "block",
        "IF(length(translate(block, chr(10), '')) = 0, NULL, "
        "named_struct('line', at, 'h1', xxhash64(block), 'h2', crc32(encode(block, 'UTF-8'))))",
    )
    # A filter on the number of lines would compute the lines a second time.
    starts = f"IF(size(lines) < {k}, CAST(array() AS ARRAY<INT>), sequence(1, size(lines) - {k - 1}))"
    windows = F.expr(f"array_compact(transform({starts}, at -> {place}))")
    places = explode_once(normal, windows, "b", "file").select("file", "b.line", "b.h1", "b.h2")
    counts = places.groupBy("h1", "h2").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    repeated = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = places.withColumn("salt", F.pmod(F.xxhash64("file", "line"), F.lit(salts)).cast("int"))
    return salted.join(repeated, ["h1", "h2", "salt"]).select(
        F.concat_ws("-", F.lower(F.hex("h1")), F.lower(F.hex("h2"))).alias("block"), "file", "line", "copies"
    )


# A key with more than this share of all rows is hot; there can only be so many of them.
_HOT = 1000


def _with_counts(places: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Places joined with the counts of their keys (`copies` and more), hot keys apart from the others.

    Keys that hold a thousandth of all places are at most a thousand: their counts are handed to every task, and none of
    their places is moved.  Of the others no key is large enough to hold a task up.
    """
    total = counts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("copies") * _HOT > total
    names = [F.col(c).alias(f"_{c}") for c in counts.columns if c not in keys]
    known = places.join(F.broadcast(counts.filter(hot).select(*keys, *names, F.lit(True).alias("_hot"))), keys, "left")
    back = [F.col(f"_{c}").alias(c) for c in counts.columns if c not in keys]
    near = known.filter("_hot").select(*places.columns, *back)
    return near.unionByName(known.filter("_hot IS NULL").select(*places.columns).join(counts.filter(~hot), keys))


def line_hashes(files: DataFrame) -> DataFrame:
    """(file, a, c): two hashes of every line, with its whitespace normalised."""
    squeezed = f"regexp_replace(code, {quote(f'(?U){SPACE[:-1]}&&[^' + chr(10) + ']]+')}, ' ')"
    lines = f"transform(split({squeezed}, chr(10), -1), text -> trim(text))"
    normal = spread(files.select("file", "code")).select("file", F.expr(lines).alias("lines"))
    hashes = "transform(lines, text -> named_struct('a', xxhash64(text), 'c', hash(text, 7)))"
    return normal.select("file", F.expr(hashes).alias("h")).select("file", F.col("h.a").alias("a"), F.col("h.c").alias("c"))


def _selected_sql(k: int) -> str:
    """Places that winnowing selects: of every `k` lines in a row, the start of the least of the shorter blocks in them.

    Equal runs of `k` lines give equal selections, so two that are equal have an equal selected block in them.
    """
    q = k // 2 + k % 2
    w = k - q + 1
    short = f"transform(sequence(1, size(a) - {q - 1}), i -> xxhash64(slice(a, i, {q})))"
    least = let(f"slice(g, j, {w})", "s", "j - 1 + array_position(s, array_min(s))")
    chosen = f"array_distinct(transform(sequence(1, size(g) - {w - 1}), j -> CAST({least} AS INT)))"
    return let(short, "g", f"transform({chosen}, at -> named_struct('at', at, 'g', get(g, at - 1)))")


def maximal_blocks(files: DataFrame, k: int = 6) -> DataFrame:
    """(block, file, line, lines, copies): one row for every place of every maximal duplicated block of `k` lines or more.

    A block goes on from line to line as long as all its places do: where one of them goes another way, or one more
    joins, the next block begins, sharing `k` - 1 lines with the last.  Whitespace is normalised; `k` blank lines are
    no block.  Every file is one row of its name.

    Lines are hashed once and kept, and texts are moved nowhere.  Winnowing selects some short blocks of each file;
    only around those that occur twice are the runs of `k` lines looked at, and counted by their hashes, 96 bits.
    """
    hashed = stored(line_hashes(files).filter(F.size("a") >= k), "line-hashes")
    q = k // 2 + k % 2
    short = explode_once(hashed, F.expr(_selected_sql(k)), "s", "file").select("file", "s.at", "s.g")
    counts = short.groupBy("g").agg(F.count("*").alias("copies")).filter("copies > 1")
    hits = _with_counts(short, stored(counts, "short-blocks"), ["g"])
    around = hits.groupBy("file").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    runs = let(
        f"array_distinct(flatten(transform(ats, at -> sequence(greatest(1, at - {k - q}), least(at, size(a) - {k - 1})))))",
        "starts",
        f"filter(transform(starts, at -> {_run_sql('at', k)}), r -> r IS NOT NULL)",
    )
    places = explode_once(hashed.join(around, "file"), F.expr(runs), "r", "file").select("file", "r.*")
    places = stored(places, "runs")
    followed = places.groupBy("h1", "h2", "n1", "n2").agg(F.count("*").alias("n"))
    followers = F.max_by(F.struct("n1", "n2", "n"), "n")
    runs_of = followed.groupBy("h1", "h2").agg(F.sum("n").alias("copies"), followers.alias("next")).filter("copies > 1")
    runs_of = stored(runs_of, "run-counts")
    # A run goes on to the next one if all its places do, and the next one has no other.
    after = runs_of.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("copies").alias("n"))
    only = runs_of.filter("next.n = copies AND next.n1 IS NOT NULL").select("h1", "h2", "next.n1", "next.n2", F.col("copies").alias("n"))
    links = stored(only.join(after, ["n1", "n2", "n"]), "links")
    goes_on = links.select(F.col("n1").alias("h1"), F.col("n2").alias("h2"), F.lit(True).alias("inner"))
    counted = runs_of.select("h1", "h2", "copies").join(goes_on, ["h1", "h2"], "left")
    found = _with_counts(places.select("file", "line", "h1", "h2"), stored(counted, "counted-runs"), ["h1", "h2"])
    begins = F.when(F.col("inner"), 0).otherwise(1)
    number = F.sum(begins).over(Window.partitionBy("file").orderBy("line"))
    first = F.min(F.struct("line", "h1", "h2"))
    blocks = found.withColumn("number", number).groupBy("file", "number").agg(
        first.alias("first"), F.count("*").alias("runs"), F.first("copies").alias("copies")
    )
    name = F.concat_ws("-", F.lower(F.hex("first.h1")), F.lower(F.hex("first.h2")), "runs")
    return blocks.select(
        name.alias("block"), "file", F.col("first.line").alias("line"), (F.col("runs") + (k - 1)).cast("int").alias("lines"), "copies"
    )


def _run_sql(at: str, k: int) -> str:
    """The run of `k` lines from a place, and the one that begins a line later; null for blank lines."""

    def hashes(start: str, one: str, two: str, absent: str) -> str:
        run = f"slice(a, {start}, {k})"
        blank = f"NOT exists({run}, x -> x != xxhash64(''))"
        return f"IF({absent}{blank}, NULL, named_struct('{one}', xxhash64({run}), '{two}', hash(slice(c, {start}, {k}), 7)))"

    own, after = hashes(at, "h1", "h2", ""), hashes(f"{at} + 1", "n1", "n2", f"{at} + {k} > size(a) OR ")
    both = f"named_struct('line', {at}, 'h1', own.h1, 'h2', own.h2, 'n1', after.n1, 'n2', after.n2)"
    return let(own, "own", f"IF(own IS NULL, NULL, {let(after, 'after', both)})")
