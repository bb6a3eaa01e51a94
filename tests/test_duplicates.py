"""Maximal duplicated blocks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lintlake.operators import duplicates
from lintlake.operators.duplicates import maximal_blocks


def naive(files, k):
    """Runs of k lines, chained while all their places go on together."""
    lines = {f: [" ".join(x.split()) for x in code.split("\n")] for f, code in files.items()}
    run = {}
    for f, ls in lines.items():
        for i in range(len(ls) - k + 1):
            if any(ls[i : i + k]):
                run[f, i] = tuple(ls[i : i + k])
    copies = Counter(run.values())
    pairs = Counter((r, run.get((f, i + 1))) for (f, i), r in run.items())
    after = {a: b for (a, b), n in pairs.items() if b and n == copies[a] == copies[b]}
    found = set()
    for (f, i), r in run.items():
        if copies[r] > 1 and after.get(run.get((f, i - 1))) != r:
            n = 1
            while after.get(run[f, i + n - 1]) and (f, i + n) in run:
                n += 1
            found.add((f, i + 1, n + k - 1, copies[r]))
    return found


def places(frame):
    rows = frame.collect()
    found = {(r.file, r.line, r.lines, r.copies) for r in rows}
    assert len(found) == len(rows)
    by_block = defaultdict(list)
    for r in rows:
        by_block[r.block].append(r)
    for some in by_block.values():
        assert len(some) == some[0].copies and len({(r.lines, r.copies) for r in some}) == 1
    return found


@pytest.mark.parametrize("k", [2, 3, 6])
@pytest.mark.parametrize("hot", [2, 1000])
def test_against_brute_force(make_files, monkeypatch, k, hot):
    monkeypatch.setattr(duplicates, "_HOT", hot)
    rng = random.Random(k)
    header = [f"licence  {i}" for i in range(8)]
    shared = [[f"s{b} {i}" for i in range(rng.randint(k, 15))] for b in range(6)]
    files = {}
    for n in range(40):
        body = [f"own {n} {i}" for i in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 3)):
            block = rng.choice(shared)
            start = rng.randint(0, len(block) - 1)
            body += block[start : rng.randint(start, len(block))] + [rng.choice(["", "}", f"x{n}"])]
        files[f"f{n:02}"] = "\n".join(header[rng.choice([0, 0, 0, 3]) :] + body)
    files |= {"loop": "a\n" * 9, "blank": "\n" * 12, "short": "licence 0", "none": "", "spaced": "\n".join("\t" + x + " " for x in header)}
    frame = make_files([(f, "go", code) for f, code in files.items()]).repartition(3)
    assert places(maximal_blocks(frame, k)) == naive(files, k)


def test_a_block_is_named_once_and_cut_where_places_part(make_files):
    common = "\n".join("abcdefgh")
    files = make_files([("1", "go", common + "\nx\ny\nz"), ("2", "go", "0\n" + common), ("3", "go", "e\nf\ng\nh\nx\ny")])
    found = places(maximal_blocks(files, 3))
    assert found == {
        ("1", 1, 6, 2), ("2", 2, 6, 2), ("1", 5, 4, 3), ("2", 6, 4, 3), ("3", 1, 4, 3), ("1", 7, 4, 2), ("3", 3, 4, 2),
    }


def test_no_place_of_a_hot_block_is_moved(make_files):
    rows = [(f"f{i}", "go", "\n".join(["one", "two", "three", f"own {i}"])) for i in range(3000)]
    frame = maximal_blocks(make_files(rows).repartition(4), 3)
    assert frame.groupBy("line", "lines", "copies").agg(F.count("*")).collect() == [(1, 3, 3000, 3000)]
    empty = make_files(rows).limit(0)
    assert maximal_blocks(empty, 3).collect() == []
