"""The queries that SQL can express against their SQL in DuckDB: over the small tables, and over odd texts."""

import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillmill.llm import decontaminate, licenses
from quillmill.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(df, columns):
    text = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df[columns].itertuples(index=False))


def duck(**tables):
    c = duckdb.connect()
    for name, (kind, rows) in tables.items():
        c.execute(f"create table {name} ({kind})")
        if rows:
            c.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), c.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_licences_in_sql():
    rng = random.Random(3)
    pieces = ["mit", "apache-2.0", "gpl-3.0+", "lgpl", "x11", "mitsubishi", "iscsi", "bsl-1.0", "cc0", "gplv3", "or", "and", "with", "OR", "With", "(", ")", "(", ")", "*/", "\n", "é", ",", "SPDX-License-Identifier:", "license-expression:", "mit license", "All rights reserved", "Apache License", "GNU General Public License"]
    texts = [None, "", "SPDX-License-Identifier: " + "(" * 60 + "mit" + ")" * 60 + " or gpl", "license-expression: mit or " * 3]
    texts += [" ".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(400)]
    texts += ["SPDX-License-Identifier: " + " ".join(rng.choices(["mit", "gpl", "isc", "or", "and", "with", "(", ")"], k=rng.randint(1, 12))) for _ in range(600)]
    rows = list(enumerate(texts))
    got = {r[0]: r[1:] for r in duck(documents=("doc_id bigint, text varchar", rows)).sql(ORACLE_SQL["op8_licenses"]).fetchall()}
    for k, t in rows:
        n, places, base, labels, score = licenses.scan(t)
        assert got[k] == (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score), t


def test_contamination_in_sql(spark, tmp_path):
    rng = random.Random(4)
    say = lambda n: [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([1, 3, 4, 5, 6, 9, 30, 60])))) for k in range(40)] + [(3, "w1 w2"), (None, "w1 w2 w3"), (70, None), (71, ""), (72, "0 1 " * 12), (1, "Ünï cödé Wörds ÀÉ one_two"), (1, "Ünï cödé Wörds ÀÉ one_two")]
    docs = []
    for k in range(150):
        own = say(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").split()
            if passage and rng.random() < 0.5:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(own))
            own[at:at] = passage
        docs.append((k, " ".join(own)))
    docs += [(200, None), (201, ""), (202, "ünï CÖDÉ wörds àé one_two"), (3, docs[3][1]), (None, docs[4][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = duck(documents=("doc_id bigint, text varchar", docs), benchmark=("item_id bigint, text varchar", items)).sql(ORACLE_SQL["op10_decontaminate"]).df()
    got = QUERIES["op10_decontaminate"](spark, str(tmp_path)).toPandas()
    columns = sorted(got.columns)
    assert len(got) > 150 and plain(got, columns) == plain(want, columns)
    assert decontaminate.BLOCK < len(items)
