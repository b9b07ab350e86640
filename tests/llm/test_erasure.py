"""The erasure against a plain version: what is in every final file, its footer, and what is reported of it."""

import datetime as dt
import hashlib
import math
import os
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from loomgraph.llm import erasure, queries

SF = "/root/testdata/sf0.001"
NAMES = ("clients", "clicks", "sales", "sale_lines")
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def first_key(v):
    return (0, 0) if v is None else (1, v)


def plain(tables, files, one_in):
    """(table, file_no) to (rows, erased, rewritten) of every final file."""
    columns = {t: tables[t].columns for t in NAMES}
    rows = {t: [tuple(r) for r in tables[t].collect()] for t in NAMES}
    at = {t: {c: i for i, c in enumerate(columns[t])} for t in NAMES}
    owner = {}
    for r in rows["sales"]:
        s, c = r[at["sales"]["sale_id"]], r[at["sales"]["client_id"]]
        if s is not None:
            owner[s] = min((x for x in (owner.get(s), c) if x is not None), default=None)
    key = {t: (lambda r, i=at[t].get("client_id"): crc(r[i])) for t in NAMES[:3]}
    key["sale_lines"] = lambda r: crc(owner.get(r[at["sale_lines"]["sale_id"]]))
    masters = {(r[at["clients"]["master_id"]], r[at["clients"]["client_id"]]) for r in rows["clients"] if r[at["clients"]["master_id"]] is not None}
    clicks = Counter(r[at["clicks"]["client_id"]] for r in rows["clicks"] if r[at["clicks"]["client_id"]] is not None)
    total = Counter()
    for m, c in masters:
        total[m] += clicks.get(c, 0)
    gone = {m for m, _ in masters if crc(m) % one_in == 0} | {m for m in total if (-total[m], m) == min((-n, k) for k, n in total.items())}
    people = {c for m, c in masters if m in gone and c is not None}
    victim = {"clients": lambda r: r[at["clients"]["master_id"]] in gone, "clicks": lambda r: r[at["clicks"]["client_id"]] in people, "sales": lambda r: r[at["sales"]["client_id"]] in people}
    sold = {r[at["sales"]["sale_id"]] for r in rows["sales"] if victim["sales"](r)} - {None}
    victim["sale_lines"] = lambda r: r[at["sale_lines"]["sale_id"]] in sold
    out = {}
    for t in NAMES:
        ordered = sorted(rows[t], key=lambda r: (key[t](r), *(first_key(v) for v in r)))
        size = 1 + len(ordered) // files
        for no in range(-(-len(ordered) // size)):
            part = ordered[no * size : (no + 1) * size]
            stay = [r for r in part if not victim[t](r)]
            if stay:
                out[t, no] = stay, len(part) - len(stay)
    return out, columns


def check(tables, files, one_in, found=None):
    want, columns = plain(tables, files, one_in)
    rows = found or erasure.erase(*(tables[t] for t in NAMES), files=files, one_in=one_in)
    assert rows.columns == ["file_no", "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", "path"]
    got = {(r["table_name"], r["file_no"]): r for r in rows.collect()}
    assert set(got) == set(want)
    for (t, no), (stay, erased) in want.items():
        r = got[t, no]
        assert (r["n_rows"], r["n_erased"], r["rewritten"], r["columns"]) == (len(stay), erased, erased > 0, ",".join(columns[t]))
        money = columns[t].index(MONEY[t])
        assert r["cents"] == sum(math.floor(100 * x[money] + 0.5) for x in stay if x[money] is not None and math.isfinite(x[money]))
        assert r["ids_sha256"] == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in stay).encode()).hexdigest()
        file = pq.ParquetFile(r["path"])
        assert file.schema_arrow.names == columns[t]
        assert repr([tuple(x.values()) for x in file.read().to_pylist()]) == repr(stay)
        for i, c in enumerate(columns[t]):
            values = [x[i] for x in stay if x[i] is not None and not (isinstance(x[i], float) and math.isnan(x[i]))]
            stats = [file.metadata.row_group(g).column(i).statistics for g in range(file.metadata.num_row_groups)]
            if values and all(s is not None and s.has_min_max for s in stats):
                assert (min(s.min for s in stats), max(s.max for s in stats)) == (min(values), max(values)), c
    paths = {r["path"] for r in got.values()}
    if paths:
        top = os.path.dirname(os.path.dirname(next(iter(paths))))
        assert {os.path.join(d, f) for d, _, names in os.walk(top) for f in names} == paths
    return got


def load(spark, **given):
    out = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in NAMES}
    return out | {t: spark.createDataFrame(r, out[t].schema) for t, r in given.items()}


def test_erasure_of_the_given_tables(spark):
    got = check(load(spark), 350, 400, queries.QUERIES["op11_erasure"](spark, SF))
    assert any(r["rewritten"] for r in got.values()) and any(not r["rewritten"] for r in got.values())


#: Client ids of equal CRC, found by search.
COLLIDING = [(37062098697, 70036722576), (95378602958, 53378977900), (57153533979, 28692865661)]


def odd_tables(spark, one_in):
    day = dt.datetime(2024, 1, 1)
    people = [c for pair in COLLIDING for c in pair] + list(range(30))
    # of two people with one CRC the first has a master that goes, the second one that stays
    goes = next(m for m in range(10_000) if crc(m) % one_in == 0)
    stays = [m for m in range(10_000) if crc(m) % one_in][:40]
    master = {c: goes if i % 2 == 0 and i < 2 * len(COLLIDING) else stays[i] for i, c in enumerate(people)}
    clients = [(c, master[c], None, None, None, None, None, None, None, None if i % 3 else float("nan") if i % 2 else -0.005) for i, c in enumerate(people)]
    clients += [(None, goes, *[None] * 7, 1.0), (None, stays[0], *[None] * 7, 2.0), (77, None, *[None] * 7, 3.0), clients[0], clients[0]]
    clicks = [(i % 17 if i % 5 else None, day, None, None if i % 11 == 0 else people[i % len(people)], None, i / 7 if i % 4 else None, "x" * (i % 3)) for i in range(400)]
    clicks += [clicks[1]] * 5 + [(1, day, None, people[5], None, 2.0, "hot")] * 300
    sales = [(i if i % 13 else None, None if i % 9 == 0 else people[i % len(people)], "done", i * 1.005, day, None, None) for i in range(200)]
    lines = [(i % 230 if i % 19 else None, i % 3, None, None, None, i / 3, None, None, None) for i in range(900)] + [(8, 1, None, None, None, None, None, None, None)] * 400
    return load(spark, clients=clients, clicks=clicks, sales=sales, sale_lines=lines)


@pytest.mark.parametrize("files", [3, 40])
def test_erasure_of_odd_rows(spark, files):
    tables = odd_tables(spark, 7)
    got = check(tables, files, 7)
    assert sum(r["n_erased"] for r in got.values()) > 0


def test_batches_of_one_row_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(erasure, "BATCH", 3)
    for plan, ids, crcs in ((True, [5, 5, 6, 1, 2, 2, 9], [1, 1, 1, 4, 4, 4, 4]), (False, [6, 5, 6, 1, 2, 1, 9], [1, 1, 1, 4, 4, 4, 4])):
        import numpy as np

        cursor = erasure._Victims([])
        cursor.batches = iter([])
        cursor.crc, cursor.id = np.array([1, 1, 4, 4, 7]), np.array([4, 6, 2, 8, 1])
        low, high = -(1 << 63), (1 << 63) - 1
        out = []
        for a in range(0, 7, 2):
            c, i = np.array(crcs[a : a + 2]), np.array(ids[a : a + 2])
            args = ((c[0], i[0]), (c[-1], i[-1]), (c[-1], i[-1])) if plan else ((c[0], low), (c[-1], high), (c[-1], low))
            out += cursor.meet(i, *args).tolist()
        assert out == [(c, i) in {(1, 6), (4, 2)} for c, i in zip(crcs, ids, strict=True)]


def test_erasure_of_empty_tables(spark):
    none = {t: [] for t in NAMES}
    assert erasure.erase(*load(spark, **none).values()).count() == 0
    got = check(load(spark, clicks=[], sales=[]), 10, 400)
    assert {t for t, _ in got} == {"clients", "sale_lines"}


def test_clashing_columns_and_many_files(spark):
    tables = odd_tables(spark, 7)
    tables["clients"] = tables["clients"].selectExpr("*", "1 AS crc", "2 AS part", "3 AS nth")
    tables["sale_lines"] = tables["sale_lines"].selectExpr("*", "'a' AS owner_crc", "'b' AS by_sale", "'c' AS crc")
    check(tables, 4, 7)


def test_a_broken_commit_is_finished_by_the_next(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    old.write_text("old"), new.write_text("new")
    row = spark.createDataFrame([(True, 1, str(new), str(old)), (True, 0, None, str(tmp_path / "gone"))], "rewritten boolean, n_rows long, staged string, path string")
    erasure.commit(row)
    erasure.commit(row)
    assert old.read_text() == "new" and not new.exists()
