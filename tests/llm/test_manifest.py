"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from candela.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, grp string, node string, root string, deal string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return digest(*[one(v) for v in (row[0], row[3], row[2], row[4], text)])


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at[i] = p // 8
        nodes = [digest(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs, lower = {}, str.maketrans(manifest.UPPER, manifest.LOWER)
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs[lang] = tree([leaf(r, r[1]) for r in groups[lang]])
    root, over = tree([subs[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, over, strict=True):
        for r, path in zip(groups[lang], subs[lang][1], strict=True):
            own = leaf(r, r[1])
            seen = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                seen = leaf(r, None if r[1] is None else r[1].translate(lower))
            for b, a in path + above:
                seen = digest(b, seen, a)
            out.append((r[0], own, subs[lang][0], root, digest(*[b + a for b, a in path + above]), seen, seen == root))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [tuple(r) for r in manifest.tamper_evidence(df).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


CLASH = (7, "g", "n", "r", "d")


@pytest.mark.parametrize("levels", [1, 3])
def test_equals_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SPAN", 8**levels)
    rows = [(i * 3, f"Text {i} É", "en" if i % 2 else "de", f"s{i % 5}", i, *CLASH) for i in range(700)]
    rows += [(i, "Solo", f"lang{i:02}", None, None, *CLASH) for i in range(9000, 9010)]
    rows += [(None, None, None, None, None, *CLASH)] * 30 + [(8, "Same", "fr", "s", 4, *CLASH)] * 90 + [(8, "Other", "fr", "s", 5, *CLASH), (9, "", "fr", "", 0, *CLASH)]
    rows += [(-5, "X" * 300_000, "", "s", 300_000, *CLASH)]
    assert order(run(spark, rows)) == order(brute(rows))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_runs_of_any_length(spark, n):
    rows = [(i, f"T{i}", "en", "s", 2, *CLASH) for i in range(n)]
    got = run(spark, rows)
    assert order(got) == order(brute(rows))
    changed = {r[0] for r in got if not r[-1]}
    assert changed == {i for i in range(n) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_sql_and_empty_table(spark):
    assert run(spark, []) == []
    rows = [(i, f"Text {i}" if i % 7 else None, [None, "en", "de"][i % 3], "s", i, *CLASH) for i in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    assert order(con.execute(manifest.sql()).fetchall()) == order(brute(rows))


def test_no_python_and_no_wide_window(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, *CLASH)], SCHEMA)
    plan = manifest.tamper_evidence(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan
