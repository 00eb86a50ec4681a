"""Tests of the third round's findings."""

import re
from hashlib import md5, sha256
from pathlib import Path

from pyspark.sql import functions as F

from glyphframe.functions import text
from glyphframe.llm import merkle
from glyphframe.operators import audit, bootstrap, boxes, layout, scores
from glyphframe.plans import registry
from glyphframe.sources import corpus, exchange


def test_strips_sql_leaves_no_ties():
    """Of components with equal ends only one may begin a strip, and both windows must agree on which."""
    orders = re.findall(r"PARTITION BY page_id ORDER BY ([a-z0-9_, ]+) ROWS", registry.ORACLE_SQL["w2_strips"])
    assert orders == ["y1, y2, comp_id"] * 2


def test_exact_draws_as_made_one_by_one(spark):
    """Exact draws of one and of many nodes, against draws made and looked up one by one; the plan holds no draw."""
    rows = [(k * k % 23, k % 9 if k % 31 else None) for k in range(700)]
    df = spark.createDataFrame(rows, "e int, c int")
    groups = df.groupBy("e", "c").agg(F.count("*").alias("_n"))
    spots = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1]))
    want = {}
    for rep in range(30):
        drawn = [spots[int(int(md5(f"7|{rep}|{j}".encode()).hexdigest()[:13], 16) / 16**13 * len(rows))] for j in range(len(rows))]
        want[rep] = (len(rows), sum(e for e, _ in drawn), sum(c or 0 for _, c in drawn))
    for bits, chunk in ((20, 25), (4, 7)):
        made = bootstrap._exact(groups, ["e", "c"], 30, 7, bits, chunk)
        assert {r.rep: (r.n, r.e, r.c) for r in made.collect()} == want
    plan = bootstrap.replicates(spark.range(50_000).select(F.col("id").alias("e")), ["e"], 30, 7)._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_layout_stays_on_its_page(spark):
    """Boxes dealt by document need one shuffle up to their lines and words, and nothing is stored."""
    for name in ("w10_assign_lines", "w13_w14_words", "w1_line_rows", "w4_text_height", "w22_line_angle"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert len(set(re.findall(r"Exchange (\w+\([^)]*\))", plan))) == 1, name
        assert "ExistingRDD" not in plan, name


def test_lines_of_rows_are_those_assigned(spark):
    """Lines found by a component's row are those found by all overlaps, on tall, thin and cut rows."""
    rows = [(k % 3, k, 10 * k % 370, (k * 37) % 400, 10 * k % 370 + 9, (k * 37) % 400 + (3, 20, 20, 20, 75)[k % 5]) for k in range(90)]
    placed = layout.in_block(spark.createDataFrame(rows, "page_id long, comp_id long, x1 long, y1 long, x2 long, y2 long"))
    want = layout.assign_lines(placed, layout.split_tall_bands(layout.line_bands(placed)))
    columns = ["page_id", "comp_id", "line", "line_y1", "line_y2"]
    assert sorted(layout.lines_of_rows(placed).select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_manifest_climbs_by_groups(spark):
    """Leaves of one group climb as one row: what a leaf shuffles does not grow with its path (op12_merkle on check_h)."""
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    docs = spark.range(6000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    before = written()
    found = merkle.verify(docs)
    assert found.where("folded = root").count() == 6000 - docs.where(merkle.tampered(F.col("doc_id"))).count()
    assert written() - before < 600 * 6000


def test_samples_take_the_disk_once(spark, tmp_path, monkeypatch):
    """Samples and lines are read without a shuffle of lines; a part is gone once it is appended (F8)."""
    made = []
    monkeypatch.setattr(corpus, "new_folder", lambda s, new=corpus.new_folder: made.append(new(s)) or made[-1])
    samples = spark.range(5000).repartition(5).selectExpr("id AS manifest_index", "concat('_meta ', id, 'é\n') AS ref", "'h' AS hyp")
    exchange.write_samples(samples, str(tmp_path / "s"), kept=5000)
    assert len(made) == 1 and not Path(made[0].removeprefix("file:")).exists()
    rows, meta = exchange.read_samples(spark, str(tmp_path / "s"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows.select("manifest_index", "ref").collect()) == sorted(samples.select("manifest_index", "ref").collect())
    assert [r.meta for r in meta.collect()] == ['{"n_kept":5000,"n_scored":5000,"n_unreadable_skipped":0}']
    plan = corpus.read_lines(spark, str(tmp_path / "s"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    (tmp_path / "m.jsonl").write_text('{"\\u005fmeta": {"n_scored": 0}}\r\n\r\n')
    assert [[r for r in x.collect()] for x in exchange.read_samples(spark, str(tmp_path / "m.jsonl"))] == [[], [('{"n_scored":0}',)]]


def _shuffled(spark):
    return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_neighbouring_indices_meet_before_the_shuffle(spark):
    """Doubled, negative and null indices count as one by one; a sample shuffles a few bytes at most."""
    rows = [(k, "ab", "ab", (k or 0) % 7 // 6, 2, 2, True) for k in (*range(-40, 90), 5, 5, -17, 88, 1 << 40, (1 << 40) + 16, None, None)]
    df = spark.createDataFrame(rows, "manifest_index long, ref string, hyp string, edits int, ref_len int, hyp_len int, correct boolean")
    assert tuple(audit.audit_metrics(df).first()) == (138, 4, sum(r[3] for r in rows), 0, 0)
    many = spark.range(200_000).selectExpr("id AS manifest_index", "'a' AS ref", "'b' AS hyp", "1 AS edits", "1 AS ref_len", "1 AS hyp_len", "false AS correct")
    before = _shuffled(spark)
    assert tuple(audit.audit_metrics(many).first()) == (200_000, 0, 0, 0, 0)
    assert _shuffled(spark) - before < 500_000


def test_tokens_of_short_and_long_pairs(spark):
    """White space is all of Unicode's; pairs of more tokens than the alphabet has, and nulls, give their distances."""
    spaces = spark.range(1, 0x3100).selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    both = spaces.select(F.size(F.filter(F.split(F.concat(F.lit("a"), "c", F.lit("b")), r"(?U)\s+"), lambda t: t != "")), text.token_count(F.concat(F.lit("a"), "c", F.lit("b"))))
    assert [r for r in both.distinct().collect() if r[0] != r[1]] == []
    words = [f"w{k}" for k in range(300)]
    rows = [(" ".join(words[:n]), "\u3000" + "\t\n".join(["x", *words[1:n], "y"])) for n in (1, 2, 92, 93, 94, 300)] + [("", " "), ("a b", ""), ("a", "a  a"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "r string, h string")
    made = df.select("r", "h", text.token_edits(F.col("r"), F.col("h")).alias("n"), text.token_count(F.col("r")).alias("of")).collect()
    assert [(r.n, r.of) for r in made] == [(2, n) for n in (1, 2, 92, 93, 94, 300)] + [(0, 0), (2, 2), (1, 1), (None, made[-2].of), (None, 1)]
    plan = df.select(text.token_edits(F.col("r"), F.col("h")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # once a text


def test_intervals_of_small_keys_meet_whole(spark):
    """Keys of few and of many intervals give all overlaps; where all keys are small no interval is cut into blocks."""
    rows = [(k % 9 if k % 9 < 8 else k % 2, k * 37 % 101, k * 37 % 101 + k % 23) for k in range(160)] + [(None, 1, 50), (50, 1, None)]
    a, b = (spark.createDataFrame(x, "k long, lo long, hi long") for x in (rows[::2], rows[1::2] + rows[:1]))
    sides = [[r for r in x if None not in r] for x in (rows[::2], rows[1::2] + rows[:1])]
    want = sorted((i, max(p, r), min(q, s)) for i, p, q in sides[0] for j, r, s in sides[1] if i == j and min(q, s) - max(p, r) >= 3)
    for few in (0, 9, 11, 1000):
        made = layout.interval_intersect(a, b, ["k"], 3, few)
        assert sorted(map(tuple, made.collect())) == want
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_arms_meet_where_they_lie(spark):
    """Arms dealt by a column pair as a join would, doubles and nulls included, and the texts are shuffled once."""
    rows = [(k % 5, k, "i" if k % 7 else None, f"r{k % 3}", None if k % 11 == 0 else f"h{k}") for k in (*range(60), 8, 8, 9, 22)]
    c = spark.createDataFrame(rows, "page long, manifest_index long, image string, ref string, hyp string")
    t = c.where("manifest_index <> 12").withColumn("hyp", F.concat("hyp", F.lit("t"))).union(c.where("manifest_index = 13"))
    want = sorted(scores.pair_arms(c, t).collect(), key=str)
    made = scores.pair_arms(*(d.repartition(8, "page").withColumn("p", F.col("page")) for d in (c, t)), dealt="p")
    assert sorted(made.collect(), key=str) == want and len(want) > 60
    plan = registry.QUERIES["j1_pair_arms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange (\w+\([^)#]*)", plan))) == 1 and "Join" not in plan


def test_boxes_match_within_the_page(spark):
    """Pairs taken by windows are those of the rounds, ties and chains included; boxes are shuffled by page alone."""
    rows = [(k % 3, k * 7 % 11, k * k % 13, 0.4 + k * 31 % 13 / 20) for k in range(150)]
    pairs = spark.createDataFrame(sorted({r[:3]: r for r in rows}.values()), "page_id long, ref_id long, det_id long, iou double")
    want = sorted(boxes.match_one_to_one(pairs.where("iou >= 0.5")).collect())
    assert sorted(boxes.with_taken(pairs).where("taken").drop("taken").collect()) == want and len(want) > 15
    for name in ("a16_w25_box_status", "a16_a17_pooled", "a18_seg_metrics"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"Exchange hashpartitioning\((\w+#?)[^,]*, \d+\)", plan)) == {"l_orderkey#"} and "Exchange hashpartitioning(page_id" not in plan, name
        assert "Join" not in plan and "ExistingRDD" not in plan, name


def _of_files(spark, tmp_path, name):
    """The paths that a query reads its small files from, by folder, and the numbers of the tasks that wrote them."""
    docs = spark.range(5_000).selectExpr("id AS doc_id", "concat('t ', id) AS text", "'en' AS lang", "concat('s', id % 3) AS source", "3L AS n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = registry.QUERIES[name](spark, str(tmp_path))
    paths = [p for p in made.inputFiles() if p.endswith(".txt")]
    folders = {}
    for p in paths:
        folders.setdefault(p.rsplit("/", 2)[0], []).append(p)
    return made, folders, {re.search(r"/part-(\d+)-", p)[1] for p in paths}


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    """Small files are not all written by the one task that their bytes fill, nor do they lie in one folder."""
    made, folders, tasks = _of_files(spark, tmp_path, "s11_read_text_dir")
    assert len(tasks) > 2 and len(folders) == 8 and {len(f) for f in folders.values()} == {32, 26}
    want = [(f, "".join(f"{k} s{k % 3}\n" for k in range(20 * f, 20 * f + 20))) for f in range(250)]
    assert sorted(map(tuple, made.collect())) == want


def test_inventory_of_files_of_many_tasks(spark, tmp_path):
    """The inventory finds each file of the many folders once, with its own bytes, hash and lines."""
    made, folders, tasks = _of_files(spark, tmp_path, "s21_file_inventory")
    assert len(tasks) > 2 and len(folders) == 8
    texts = ("".join(f"{k} s{k % 3}\n" for k in range(20 * f, 20 * f + 20)) for f in range(250))
    assert sorted(map(tuple, made.collect())) == [(f, len(x), sha256(x.encode()).hexdigest(), 20) for f, x in enumerate(texts)]


def test_manifests_of_many_tasks_and_folders(spark, tmp_path):
    """Manifests share F23's step; those in folders below the one named are read, each with line numbers of its own."""
    made, folders, tasks = _of_files(spark, tmp_path, "s6_read_manifest")
    assert len(tasks) > 2 and len(folders) == 4 and sum(map(len, folders.values())) == 100
    want = [(k % 50 * 2, md5(f"t {k}".encode()).hexdigest(), f"{k // 50}.jpg") for k in range(5_000)]
    assert sorted(map(tuple, made.collect())) == sorted(want)
