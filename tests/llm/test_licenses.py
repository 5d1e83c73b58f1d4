from pathlib import Path

from ledgerline.llm import licenses
from ledgerline.llm.license_texts import TEXTS

MIT = next(t for n, _, t in TEXTS if n == "MIT")


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}


def test_variants_of_one_text(spark):
    same = [
        MIT,
        "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + MIT,
        "The MIT License (MIT)\n\n  Copyright © 2011-2013 A, B. All rights reserved.\n" + MIT.replace(" ", "\n ").upper(),
        "/* " + MIT.replace("sublicense", "sub-license").replace('"', "“") + " */",
    ]
    assert [r["license"] for r in scanned(spark, same).values()] == ["MIT"] * 4


def test_other_texts_do_not_match(spark):
    rows = scanned(spark, [MIT + " And more.", MIT[:200], "", None, "Copyright 2020 X", "Copyright holders keep this line"])
    assert all(r["license"] is None for r in rows.values())
    assert rows[3]["license_digest"] is None
    assert rows[2]["license_digest"] == rows[4]["license_digest"] != rows[5]["license_digest"]


def test_every_known_text_is_found(spark):
    known = licenses.known_texts()
    rows = scanned(spark, [t for _, t in known])
    assert [rows[i]["license"] for i in range(len(known))] == [n for n, _ in known]


def test_awkward_rows(spark, tricky, nothing):
    known = licenses.known_digests(spark)
    out = licenses.scan_licenses(tricky, known)
    assert out.columns == [*tricky.columns, "license_digest", "license_"] and out.count() == tricky.count()
    assert licenses.scan_licenses(nothing, known).count() == 0
    assert licenses.scan_licenses(tricky, known.limit(0)).count() == tricky.count()


def test_many_known_digests_are_shuffled(spark, tricky, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_KNOWN", 3)
    docs = spark.createDataFrame([(1, MIT), (2, "x"), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()} == {1: "MIT", 2: None, 3: None}


def test_entire_licences(spark):
    folder = Path(licenses.__file__).parent / "license_files"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    whole = [(folder / f).read_text("utf-8") for f in names]
    terms = [t.partition("END OF TERMS AND CONDITIONS")[0] for t in whole[:3]]
    rows = scanned(spark, [*whole, *terms, whole[2].upper().replace(" ", "  "), whole[0][:5000]])
    assert [rows[i]["license"] for i in range(len(rows))] == [*names.values(), *list(names.values())[:3], "GPL-3.0", None]


def test_the_sql_finds_planted_licenses(spark, tmp_path):
    """The query and its SQL on a table that holds every known text, variants and near misses."""
    import duckdb

    from ledgerline.llm import queries

    texts = [t for _, t in licenses.known_texts()]
    texts += [t.upper().replace(" ", "\n") for t in texts[:8]] + ["Copyright (c) 2024 A B\n" + t for t in texts[:8]] + [t + " more" for t in texts[:8]] + ["", None, "plain words"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["license_digest"], r["license"]) for r in queries.op3_licenses(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.sql(licenses.ORACLE_SQL).df().astype(object)
    want = sorted((r.doc_id, *(None if v != v or v is None else v for v in (r.license_digest, r.license))) for r in found.itertuples())
    assert got == want and sum(r[2] is not None for r in got) >= len(licenses.known_texts()) + 8
