import hashlib
import os
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import text_ledger
from railyard.queries import jobs as queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
SHA = lambda x: hashlib.sha256((x or "").encode()).hexdigest()


def put(spark, rows, path, at):
    """A file of the given time."""
    there = set(path.glob("*.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(str(path))
    for p in set(path.glob("*.parquet")) - there:
        os.utime(p, (at, at))


def ledger(spark, out):
    return sorted((r.grp, r.id, r.source, r.sha256, r.n_chars, r.n_lines) for r in text_ledger.result(spark, str(out))[0].collect())


def sources(spark, out):
    return {(r.grp, r.source): (r.n_texts, r.n_different, r.n_elsewhere, r.n_chars, round(r.share, 9)) for r in text_ledger.result(spark, str(out))[1].collect()}


def files(out, *names):
    return {(str(p), p.stat().st_mtime_ns) for name in names for p in out.glob(f"{name}/**/*.parquet")}


def brute(*parts):
    """Sources by the newest text of each (group, id)."""
    newest = {}
    for at, rows in enumerate(parts):
        for i, text, lang, source in rows:
            key = (lang or "", i)
            own = (at, SHA(text), source or "", text or "")
            if not any(x[1] == SHA(text) for x in newest.setdefault(key, [])):
                newest[key].append(own)
    per, where, chars = defaultdict(list), defaultdict(set), defaultdict(int)
    for (grp, _), own in newest.items():
        _, sha, source, text = max(own)
        per[grp, source].append((sha, len(text)))
        where[grp, sha].add(source)
        chars[grp] += len(text)
    return {(g, s): (len(v), len({x for x, _ in v}), sum(len(where[g, x]) > 1 for x, _ in v), sum(n for _, n in v), round(sum(n for _, n in v) / chars[g], 9) if chars[g] else 0.0) for (g, s), v in per.items()}


FIRST = [(1, "one\ntwo", "en", "a"), (2, "same", "en", "a"), (3, "same", "en", "b"), (4, None, "fr", None), (5, "", None, "a"), (2, "same", "en", "a"), (6, "x" * 100_000, "fr", "c")]
SECOND = [(1, "one\ntwo, changed", "en", "a"), (7, "same", "en", "c"), (2, "same", "en", "a")]
NOW = int(time.time()) - 1000


def test_two_runs_over_growing_input(spark, tmp_path):
    docs, out = tmp_path / "documents", tmp_path / "out"
    for k, own in enumerate((True, False)):  # what only older files have isn't worked out again
        put(spark, [r for r in FIRST if (r[2] == "fr") == own], docs, NOW + k)
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 6}
    assert sources(spark, out) == brute(FIRST)
    french = files(out, "sources/name=documents/grp=fr", "ledger/name=documents/grp=fr")

    put(spark, SECOND, docs, NOW + 100)
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 2}
    assert ledger(spark, out) == sorted({(g or "", str(i), s or "", SHA(t), len(t or ""), len((t or "").split("\n"))) for i, t, g, s in FIRST + SECOND})
    assert sources(spark, out) == brute(FIRST, SECOND)
    assert french and french == files(out, "sources/name=documents/grp=fr", "ledger/name=documents/grp=fr")

    before = ledger(spark, out), sources(spark, out), files(out, "ledger")
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 0}
    assert (ledger(spark, out), sources(spark, out)) == before[:2] and files(out, "ledger") == before[2]


def test_only_new_files_are_read(spark, tmp_path):
    docs, out = tmp_path / "documents", tmp_path / "out"
    put(spark, FIRST, docs, NOW)
    text_ledger.run(spark, {"documents": str(docs)}, str(out))
    for p in docs.glob("*.parquet"):  # a file from before the mark is not opened again
        p.chmod(0o644)
        p.write_bytes(b"no longer Parquet")
        os.utime(p, (NOW - 100, NOW - 100))
    new = tmp_path / "new"
    put(spark, SECOND, new, NOW + 100)
    for p in new.glob("*.parquet"):
        os.rename(p, docs / f"a{p.name}")  # first, for the schema
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 2}


@pytest.mark.parametrize("lost", ["marks", "sources"])
def test_a_run_that_was_broken_off_is_made_good(spark, tmp_path, lost):
    docs, out = tmp_path / "documents", tmp_path / "out"
    put(spark, FIRST, docs, NOW)
    text_ledger.run(spark, {"documents": str(docs)}, str(out))
    for p in out.glob(f"{lost}/**/*"):
        if p.is_file():
            p.unlink()
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 0}
    assert ledger(spark, out) == sorted({(g or "", str(i), s or "", SHA(t), len(t or ""), len((t or "").split("\n"))) for i, t, g, s in FIRST})
    assert sources(spark, out) == brute(FIRST)


def test_empty_tables_and_ids(spark, tmp_path):
    docs, out = tmp_path / "documents", tmp_path / "out"
    put(spark, [], docs, NOW)
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 0}
    put(spark, [(None, "a", "en", "s"), (None, "b", "en", "s"), (None, "a", "en", "s")], docs, NOW + 10)
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 2}
    assert text_ledger.run(spark, {"documents": str(docs)}, str(out)) == {"documents": 0}
    assert sources(spark, out) == {("en", "s"): (2, 2, 0, 2, 1.0)}


def test_copies_of_the_table_in_two_parts(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    for k in (0, 1):
        put(spark, rows.filter(F.pmod("doc_id", F.lit(2)) == k).select("doc_id", "text", "lang", "source").collect(), tmp_path / "documents", NOW + k)
        assert text_ledger.run(spark, {"documents": str(tmp_path / "documents")}, str(tmp_path / "out")) == {"documents": rows.count() / 2}
    whole = tmp_path / "whole"
    text_ledger.run(spark, {"documents": f"{SF}/documents.parquet"}, str(whole))
    assert (ledger(spark, whole), sources(spark, whole)) == (ledger(spark, tmp_path / "out"), sources(spark, tmp_path / "out"))


def test_query_is_its_sql(spark):
    assert differences(spark, queries.job2_text_ledger, queries.TEXT_LEDGER, SF) == ""
