import gzip

from pyspark.sql import functions as F

from kinloom.config import Config
from kinloom.operators import evaluate
from kinloom.plans.scratch import Scratch
from kinloom.sources import files, parsers, sinks


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;n\n"A; ""B""";1\n"two\nlines";2\n')
    assert [tuple(r) for r in files.read_commits(spark, str(tmp_path / "a.csv")).collect()] == [('A; "B"', "1"), ("two\nlines", "2")]
    (tmp_path / "b.csv").write_text("name,n\né,\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv"), schema="name string, n int").collect()] == [("é", None)]


def test_shards_of_any_suffix(spark, tmp_path):
    big = [f"r{i};a{i}" for i in range(300_000)]
    (tmp_path / "p.0.s").write_bytes(gzip.compress("\n".join(big[:200_000]).encode()))
    (tmp_path / "p.1.s").write_bytes(gzip.compress(("\n".join(big[200_000:250_000]) + "\n").encode()) + gzip.compress("\n".join(big[250_000:]).encode() + b"\n\n\xff;x"))
    (tmp_path / "p.2.s").write_bytes(gzip.compress(b""))
    got = sorted(r.value for r in files.read_shards(spark, f"{tmp_path}/*.s").collect())
    assert got == sorted([*big, "ÿ;x"])


def test_log_names_and_rows(spark, tmp_path):
    log = spark.createDataFrame(list(enumerate(["Ann;a@x;d;1", "Bo;b@x;d;2", "Ann;a@x;e;3", "broken", "Cy;c@x;d;4;5"])), "pos long, value string")
    assert sorted(map(tuple, files.log_aliases(log).collect())) == [(1, "Ann", "a@x"), (2, "Bo", "b@x"), (3, "Cy", "c@x")]
    (tmp_path / "f.txt").write_text("Ann\n bo \n\nANN\n")
    (tmp_path / "m.txt").write_text("Cy\n")
    assert files.with_first_names(spark, Config(), str(tmp_path / "f.txt"), str(tmp_path / "m.txt")).first_names == ("ann", "bo", "cy")
    d = spark.createDataFrame([("é\n\"", None), (None, 3)], "s string, n long")
    back = d.withColumn("j", files.to_row("s", "n")).select(files.from_row("j", "s string, n long").alias("r")).select("r.*")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, d.collect()), key=str)
    assert spark.createDataFrame([("{oops",)], "j string").select(files.from_row("j", "n long").alias("r")).select("r.n").first().n is None


def test_clusters_of_mappings_and_other_tools(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")], "id long, alias string")
    m = spark.createDataFrame([("c", "b"), ("b", "a"), ("e", "e")], "source string, target string")
    assert {r.id: r.cluster for r in evaluate.mapped(a, m).collect()} == {0: "a", 1: "a", 2: "a", 3: "d", 4: "e"}
    x = spark.createDataFrame([(0, 7), (2, 7), (1, 8)], "id long, author_id long")
    assert {r.id: r.cluster for r in evaluate.external(a, x).collect()} == {0: "7", 2: "7", 1: "8", 3: "own 3", 4: "own 4"}


def test_resolve_file(spark, tmp_path):
    (tmp_path / "in.txt").write_text("Ana Quill <ana.quill@a.org>\naquill <ANA.QUILL@a.org>\nRowan Tesk;r@x.org\nTesk, Rowan;t@y.org\n\nnonsense\n")
    found = files.resolve_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), "p")
    back = spark.read.csv(str(tmp_path / "out"), sep=";", header=True)
    assert found.count() == back.count() == 4 and back.select("dealiased_author_id").distinct().count() == 2
    assert {r.dealiased_author_id for r in back.where(F.col("original_author_id").contains("quill")).collect()} == {"Ana Quill <ana.quill@a.org>"}


def test_written_texts_come_back(spark, tmp_path):
    d = spark.createDataFrame([(' a "q"; x', "one,"), ("", ' "'), ("line\nend ", "ü")], "original_author_id string, t string")
    sinks.write_resolution(d, str(tmp_path / "r"))
    sinks.write_csv(d, str(tmp_path / "c"))
    for found in (files.read_commits(spark, str(tmp_path / "r")), files.read_csv(spark, str(tmp_path / "c"))):
        assert sorted((a or "", b) for a, b in found.collect()) == sorted(map(tuple, d.collect()))


def test_lines_are_numbered_over_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i} {j}\n" for j in range(5 - i)))
    assert [r.value for r in parsers.lines(spark, str(tmp_path)).orderBy("pos").collect()] == [f"{i} {j}" for i in range(3) for j in range(5 - i)]
    assert sorted(r.pos for r in parsers.lines(spark, str(tmp_path)).collect()) == list(range(12))


def test_interval_table(spark):
    d = spark.createDataFrame([("m", float(x)) for x in range(40)] + [("one", 2.0)], "metric string, value double")
    rows = {r.metric: r for r in evaluate.interval_table(d, 90, 2000).collect()}
    m = rows["m"]
    assert (m.n, m.mean, m.median) == (40, 19.5, 19.5) and abs(m.std - 11.5434) < 1e-3
    assert abs(m.normal_ci_90_lower - 16.3857) < 1e-2 and abs(m.normal_ci_90_upper - 22.6143) < 1e-2
    assert abs(m.bootstrap_ci_90_lower - 16.5) < 0.5 and abs(m.bootstrap_ci_90_upper - 22.5) < 0.5
    assert rows["one"].normal_ci_90_lower == rows["one"].bootstrap_ci_90_upper == 2.0


def test_resolve_file_prepares_aliases_once(spark, tmp_path, monkeypatch):
    made, real = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name="t": made.append("word_forms" in df.columns) or real(self, df, name))
    (tmp_path / "in.txt").write_text("Ann Lee <ann@a.org>\nAnn Lee <lee@b.org>\n")
    files.resolve_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), "p")
    assert sum(made) == 1
