"""Commands, exit codes, files on disk."""

from framewright import cli
from framewright import queries as q
from framewright.operators import lockfile as lk
from framewright.sources import corpus_files as cf
from framewright.streaming.verify_stream import verify_arrivals

ONE = "0016x0016-10-30fps-solid-disc-fixed-raw-iso-identity-unscaled-cap240-nodef"


def test_list_manifest_and_usage(spark, capsys):
    assert cli.run(spark, ["list"]) == 0
    names = capsys.readouterr().out.split()
    assert len(names) == 138 and ONE in names
    assert cli.run(spark, ["manifest", ONE]) == 0
    text = capsys.readouterr().out
    assert '"capture_carrier":"cfps","capture_rate":{"den":1,"num":240}' in text and " " not in text.strip()
    assert cli.run(spark, ["manifest", "nothing"]) == 1 and cli.run(spark, []) == 1 and cli.run(spark, ["verify"]) == 1


def test_generate_lock_verify(spark, tmp_path, capsys):
    out, lock = str(tmp_path / "out"), str(tmp_path / "catalog.lock")
    assert cli.run(spark, ["generate", "--out", out, "--only", ONE, "--only", "unknown"]) == 0
    assert cli.run(spark, ["lock", "--write", lock, "--only", ONE]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{ONE}-media.mp4", f"{ONE}.json"]
    capsys.readouterr()
    assert cli.run(spark, ["verify", "--lock", lock, "--corpus", out]) == 0
    assert "2 verified, 2 matched, 0 failed" in capsys.readouterr().out
    assert cli.run(spark, ["verify", "--lock", lock, "--only", ONE]) == 0
    assert cli.run(spark, ["verify", "--lock", lock, "--only", "unknown"]) == 1
    (tmp_path / "out" / f"{ONE}.json").write_text("{}")
    (tmp_path / "out" / "more.json").write_text("{}")
    capsys.readouterr()
    assert cli.run(spark, ["verify", "--lock", lock, "--corpus", out]) == 1
    said = capsys.readouterr().out
    assert "extra more.json" in said and f"digest {ONE}.json" in said and f"length {ONE}.json" in said
    with open(lock, "a", encoding="utf-8") as f:
        f.write(open(lock, encoding="utf-8").readline())
    assert cli.run(spark, ["verify", "--lock", lock]) == 1
    (tmp_path / "bad.lock").write_text("one two\n")
    assert cli.run(spark, ["verify", "--lock", str(tmp_path / "bad.lock"), "--corpus", out]) == 1
    assert cli.run(spark, ["verify", "--lock", str(tmp_path / "none.lock")]) == 1


def test_arrivals_are_verified(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("{}")
    (tmp_path / "in" / "b.json").write_text("[]")
    expected = lk.digests(spark.createDataFrame([("a.json", "{}"), ("b.json", "?"), ("c.json", "")], "name string, content string"))
    got = []
    s = verify_arrivals(spark, str(tmp_path / "in"), expected, lambda df, n: got.extend(tuple(r)[:2] for r in df.collect()), str(tmp_path / "state"))
    s.awaitTermination(60)
    assert sorted(got) == [("digest", "b.json"), ("length", "b.json")]
    assert cf.read_corpus(spark, str(tmp_path / "in")).where("valid").count() == 2


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8 and set(e.oracle_sql()) <= set(e.queries()) and set(q.ORACLES) <= set(e.oracle_sql())
