import pytest
from brightwater import ATTACHED, Frame, Graph, call_table, col, define, define_table, fts_search, list_macros, macro_setup_sqls, session, sql, undefine
from brightwater.operators.fts import porter, snowball
from brightwater.sources.io import Attached
from pyspark.sql import functions as F


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_degrees_and_repr(spark):
    g = Graph.from_edgelist(edges(spark, [(1, i) for i in range(2, 6)] + [(1, 1)]))
    assert as_dict(g.out_degree()) == {1: 5} and as_dict(g.in_degree())[2] == 1 and as_dict(g.degree())[1] == 6
    assert "5 vertices, 5 edges" in repr(g)


def test_pagerank(spark):
    cycle = as_dict(Graph.from_edgelist(edges(spark, [(1, 2), (2, 3), (3, 1)])).pagerank())
    assert all(abs(v - 1 / 3) < 1e-6 for v in cycle.values())
    star = as_dict(Graph.from_edgelist(edges(spark, [(i, 1) for i in range(2, 6)])).pagerank())
    assert max(star, key=star.get) == 1 and abs(star[2] - 0.03) < 1e-9
    alone = Graph(spark.createDataFrame([(1,)], "id long"), edges(spark, []))
    assert abs(as_dict(alone.pagerank())[1] - 0.15) < 1e-9 and as_dict(alone.connected_components()) == {1: 1}


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 4, 1.5), (1, 3, 10.0), (3, 4, 1.0)], "src long, dst long, cost double")
    g = Graph.from_edgelist(e)
    assert as_dict(g.shortest_paths(1)) == {1: 0, 2: 1, 3: 1, 4: 2} and as_dict(g.shortest_paths(1, max_depth=1)) == {1: 0, 2: 1, 3: 1}
    assert as_dict(g.shortest_paths(1, weight="cost")) == {1: 0.0, 2: 1.0, 3: 10.0, 4: 2.5} and as_dict(g.shortest_paths(99)) == {99: 0}


def test_components_communities_triangles(spark):
    g = Graph(spark.range(1, 8).toDF("id"), edges(spark, [(1, 2), (2, 3), (3, 1), (5, 4)]))
    assert as_dict(g.connected_components()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    both = [(a, b) for x in ([1, 2, 3], [4, 5, 6]) for a in x for b in x if a != b]
    h = Graph.from_edgelist(edges(spark, both))
    assert as_dict(h.communities()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4} and h.triangle_count() == 2


def test_betweenness(spark):
    star = Graph.from_edgelist(edges(spark, [(1, i) for i in range(2, 6)]))
    assert as_dict(star.betweenness_centrality()) == {1: 2.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    chain = as_dict(Graph.from_edgelist(edges(spark, [(1, 2), (2, 3), (3, 4), (1, 4)])).betweenness_centrality(normalize=False))
    assert all(abs(v - 1.0) < 1e-9 for v in chain.values())


def test_json(spark):
    f = Frame(spark.createDataFrame([(1, '{"a": {"b": "x"}, "l": [1, "x", {"z": 2}], "n": null}'), (2, '{"l": []}'), (3, None), (4, "not json")], "id int, j string"))
    assert [r["b"] for r in f.json_extract("j", {"b": "a.b"}).sort_by("id").to_rows()] == ["x", None, None, None]
    assert sorted(r["item"] for r in f.json_unnest("j", "l", "item").to_rows()) == ['"x"', "1", '{"z":2}']
    assert f.filter(col("id") < 4).json_expand("j").columns == ["id", "j", "a", "l", "n"]


def test_search(spark):
    f = Frame(spark.createDataFrame([(1, "Running dogs", "the quick brown fox"), (2, "Cats", "a dog ran, dogs run"), (3, "Café", None)], "id int, title string, body string"))
    ix = f.fts_index("id", ["title", "body"])
    got = fts_search(ix, "dog").collect()
    assert {r["id"] for r in got} == {1, 2} and got[0]["fts_score"] >= got[1]["fts_score"]
    assert [r["id"] for r in fts_search(ix, "cafe", limit=1).collect()] == [3]
    assert [r["id"] for r in fts_search(ix, "dogs", fields=["title"]).collect()] == [1] and fts_search(ix, "the").count() == 0
    with pytest.raises(ValueError):
        fts_search(None, "x")
    with pytest.raises(ValueError):
        f.fts_index("id", "nope")
    for stemmer in ("klingon", "french"):
        with pytest.raises(ValueError, match=stemmer):
            f.fts_index("id", "title", stemmer=stemmer)
    for stemmer in ("english", "porter", "none"):  # a built index and a lazy one answer alike
        lazy, built = (f.fts_index("id", ["title", "body"], stemmer=stemmer, build=b) for b in (False, True))
        for words in ("dogs running", "the", "quick café dog"):
            assert [tuple(r) for r in fts_search(lazy, words).collect()] == [tuple(r) for r in fts_search(built, words).collect()]


@pytest.mark.parametrize(("word", "stem"), [("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriating", "luxuri"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("succeed", "succeed"), ("skies", "sky"), ("communication", "communic"), ("relational", "relat"), ("youth", "youth"), ("knack", "knack"), ("consolingly", "consol"), ("agreed", "agre"), ("bed", "bed")])
def test_snowball(word, stem):
    assert snowball(word) == stem


def test_every_term_of_a_stem_is_found(spark):
    words = ["hope", "hoping", "hoped", "happy", "happily", "happiness", "tie", "ties", "tied", "sky", "skies", "relate", "relational", "relation", "be", "being", "ski", "skis", "y", "yes", "apple", "apples", "as", "cry", "cries"]
    f = Frame(spark.createDataFrame(list(enumerate(words)), "id int, body string"))
    for stemmer, stem in (("english", snowball), ("porter", porter)):
        ix = f.fts_index("id", "body", stemmer=stemmer, stopwords="none")
        for w in ("hopes", "happy", "ties", "skies", "relations", "be", "skis", "apples", "cries"):
            assert {r["body"] for r in fts_search(ix, w).collect()} == {x for x in words if stem(x) == stem(w)}, (stemmer, w)


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_macros(spark):
    define("add_one", ["x"], "x + 1")
    define("twice", ["x"], "add_one(x) * 2")
    define("pick", ["select"], '"select" + 0')
    define("pi4", [], "3.1415")
    one = lambda t: spark.range(1).select(sql(t).alias("v")).first()[0]
    assert one("twice(3)") == 8 and one("twice(1 + 1) + add_one(0)") == 7 and one("pick(4)") == 4 and float(one("pi4()")) == 3.1415
    define("add_one", ["x"], "x + 10")
    assert one("twice(1)") == 22
    with pytest.raises(Exception):  # noqa: B017, PT011
        define("broken", ["x"], "x + + )")
    assert "broken" not in [m["name"] for m in list_macros()]
    with pytest.raises(ValueError, match="arguments"):
        sql("add_one(1, 2)")
    define_table("upto", ["n"], "SELECT id FROM range(n)")
    assert Frame.from_query(spark, "SELECT count(*) AS c FROM upto(5)").to_rows() == [{"c": 5}] and call_table(spark, "upto", 3).count() == 3
    assert any("upto" in s for s in macro_setup_sqls())
    for m in ("add_one", "twice", "pick", "pi4", "upto", "never_there"):
        undefine(m)


def test_files(spark, tmp_path):
    f = Frame.from_list(spark, [{"id": 1, "s": 'a "q", b', "x": 1.5}, {"id": 2, "s": "line\nbreak", "x": None}, {"id": 3, "s": None, "x": -2.0}])
    key = lambda rs: sorted(rs, key=lambda r: r["id"])
    f.to_csv(str(tmp_path / "a.csv"))
    assert key(Frame.from_csv(spark, str(tmp_path / "a.csv")).to_rows()) == key(f.to_rows())
    f.to_ndjson(str(tmp_path / "a.ndjson"))
    assert key(Frame.from_ndjson(spark, str(tmp_path / "a.ndjson")).to_rows()) == key(f.to_rows())
    f.to_parquet(str(tmp_path / "p"), partition_by="id", compression="zstd")
    assert (tmp_path / "p" / "id=2").is_dir() and Frame.from_parquet(spark, str(tmp_path / "p")).n_rows() == 3
    f.to_excel(str(tmp_path / "a.xlsx"))
    got = key(Frame.from_excel(spark, str(tmp_path / "a.xlsx")).to_rows())
    assert got == [{**r, "id": float(r["id"])} for r in key(f.to_rows())]
    assert Frame.from_excel(spark, str(tmp_path / "a.xlsx"), range="A2:B3", header=False, all_varchar=True).columns == ["A", "B"]
    (tmp_path / "s.csv").write_text("junk\nmore\na;b\n1;NA\n2;x\n")
    assert Frame.from_csv(spark, str(tmp_path / "s.csv"), delimiter=";", skip=2, nullstr="NA", types={"a": "BIGINT"}).to_rows() == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    with pytest.raises(ValueError):
        Frame.from_excel(spark, "x", pages=2)
    with pytest.raises(ValueError):
        Frame.from_csv(spark, "x", colour=2)


def test_insert_into(spark):
    f = Frame(spark.range(3))
    spark.sql("DROP TABLE IF EXISTS bw_t")
    with pytest.raises(ValueError, match="no table"):
        f.insert_into("bw_t")
    f.insert_into("bw_t", create=True)
    f.insert_into("bw_t")
    assert spark.table("bw_t").count() == 6
    spark.sql("DROP TABLE bw_t")


def test_single_files_go_through_the_file_system(spark, tmp_path):
    f = Frame(spark.range(3).selectExpr("id", "concat('v', id) AS v"))
    target = f"file://{tmp_path}/x.csv"  # a path with a scheme, which open() does not take
    f.to_csv(target)
    f.to_csv(target)  # again: the file is replaced
    assert sorted((tmp_path / "x.csv").read_text().split()) == ["0,v0", "1,v1", "2,v2", "id,v"]
    f.filter(col("id") > 9).to_csv(f"{tmp_path}/none.csv")
    assert (tmp_path / "none.csv").read_text() == "id,v\n" and [p.name for p in tmp_path.iterdir() if "writing" in p.name] == []
    f.to_ndjson(f"{tmp_path}/x.ndjson")
    assert len((tmp_path / "x.ndjson").read_text().splitlines()) == 3
    with pytest.raises(Exception):  # noqa: B017, PT011
        f.to_csv("nosuchscheme://h/x.csv")


def test_csv_lines_are_split_unless_quotes_say_otherwise(spark, tmp_path):
    from brightwater.sources.io import breaks_lines

    (tmp_path / "a.csv").write_text('id,s\n1,"x, y"\n2,"say ""hi"""\n')
    (tmp_path / "b.csv").write_text('id,s\n1,"x\ny"\n')
    assert not breaks_lines(spark, str(tmp_path / "a.csv")) and breaks_lines(spark, str(tmp_path / "b.csv"))
    assert Frame.from_csv(spark, str(tmp_path / "a.csv")).to_columns()["s"] == ["x, y", 'say "hi"']
    assert Frame.from_csv(spark, str(tmp_path / "b.csv")).to_columns()["s"] == ["x\ny"]
    assert Frame.from_csv(spark, str(tmp_path / "b.csv"), multiline=False).n_rows() == 2
    for n in ("p", "q"):
        (tmp_path / f"skip-{n}.csv").write_text(f"junk\nmore junk\nid,s\n{ord(n)},{n}\n")
    assert sorted(Frame.from_csv(spark, f"{tmp_path}/skip-*.csv", skip=2).to_columns()["s"]) == ["p", "q"]


def test_a_real_database(spark, tmp_path):
    """The Derby of Spark's own distribution, attached over JDBC."""
    ATTACHED.attach("db", f"jdbc:derby:{tmp_path}/db;create=true", type="jdbc", read_only=False)
    try:
        f = Frame(spark.range(40).selectExpr("CAST(id AS INT) AS ID", "concat('n', id) AS NAME"))
        f.insert_into("db.T", create=True)
        f.filter(col("ID") < 5).insert_into("db.T")
        back = Frame.from_attached(spark, "db", "T")
        assert back.n_rows() == 45 and back.filter(col("ID") == 3).to_columns()["NAME"] == ["n3", "n3"]
        parts = Frame.from_attached(spark, "db", "T", partition_by="ID", partitions=4)
        assert parts.df.rdd.getNumPartitions() == 4 and parts.n_rows() == 45
        assert back.join(f, "ID").n_rows() == 45
        with pytest.raises(Exception):  # noqa: B017, PT011
            f.insert_into("db.T", create=True)
        ATTACHED.entries["db"]["read_only"] = True
        with pytest.raises(ValueError, match="read-only"):
            f.insert_into("db.T")
    finally:
        ATTACHED.detach("db")


def test_store_secrets_take_effect(spark):
    a, conf = Attached(), spark._jsc.hadoopConfiguration()
    a.create_secret("all", type="s3", key_id="k", secret="x", region="r")
    a.create_secret("one", type="s3", key_id="k2", secret="y", scope="s3://lake/part")
    assert (conf.get("fs.s3a.access.key"), conf.get("fs.s3a.endpoint.region"), conf.get("fs.s3a.bucket.lake.access.key")) == ("k", "r", "k2")
    a.drop_secret("all"), a.drop_secret("one")
    assert conf.get("fs.s3a.access.key") is None and conf.get("fs.s3a.bucket.lake.secret.key") is None


def test_more_json_keys_than_wanted_are_an_error(spark):
    f = Frame(spark.createDataFrame([('{"a": 1, "b": 2, "c": 3}',)], "j string"))
    assert f.json_expand("j", most=3).columns == ["j", "a", "b", "c"]
    with pytest.raises(ValueError, match="more than 2 keys"):
        f.json_expand("j", most=2)


def test_graphs_with_odd_vertices(spark):
    alone = Graph(spark.createDataFrame([(1,), (2,), (3,)], "id long"), edges(spark, [(1, 2)]))
    assert as_dict(alone.connected_components()) == {1: 1, 2: 1, 3: 3} and as_dict(alone.communities())[3] == 3
    assert as_dict(alone.betweenness_centrality()) == {1: 0.0, 2: 0.0, 3: 0.0} and alone.triangle_count() == 0
    single = Graph(spark.createDataFrame([(7,)], "id long"), edges(spark, []))
    assert as_dict(single.betweenness_centrality()) == {7: 0.0} and single.triangle_count() == 0 and as_dict(single.communities()) == {7: 7}
    half = Graph.from_edgelist(spark.createDataFrame([(1, 2), (2, None), (None, 4)], "src long, dst long"))
    assert set(as_dict(half.pagerank())) == {1, 2, 4}


def test_triangles_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    pairs = [(rng.randrange(40), min(39, int(rng.expovariate(0.15)))) for _ in range(700)]  # hubs, loops and repeats
    have = set(pairs)
    want = {(a, b, c) for a in range(40) for b in range(a + 1, 40) for c in range(b + 1, 40) if {(a, b), (b, c), (c, a)} <= have}
    got = [tuple(r) for r in Graph.from_edgelist(edges(spark, pairs)).triangles().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


# The friendships of Zachary's karate club (1977), by the later member
KARATE = (
    "2:1 3:1,2 4:1,2,3 5:1 6:1 7:1,5,6 8:1,2,3,4 9:1,3 10:3 11:1,5,6 12:1 13:1,4 14:1,2,3,4 17:6,7 18:1,2 20:1,2 22:1,2 26:24,25 28:3,24,25 29:3 30:24,27 "
    "31:2,9 32:1,25,26,29 33:3,9,15,16,19,21,23,24,30,31,32 34:9,10,14,15,16,19,20,21,23,24,27,28,29,30,31,32,33"
)


def test_karate_club(spark, tmp_path):
    from brightwater.sources import datasets

    pairs = [(int(b), int(a)) for part in KARATE.split() for a, bs in [part.split(":")] for b in bs.split(",")]
    (tmp_path / "karate_club.csv").write_text("src,dst\n" + "".join(f"{a},{b}\n" for a, b in pairs))
    g = datasets.karate_club(spark, str(tmp_path))
    assert (g.vertex_count(), g.edge_count(), g.triangle_count()) == (34, 156, 45)
    ranks = as_dict(g.pagerank())
    assert max(ranks, key=ranks.get) == 34 and set(as_dict(g.connected_components()).values()) == {1}
    middle = as_dict(g.betweenness_centrality(sample=34))
    assert max(middle, key=middle.get) == 1 and abs(middle[1] - 2 * 0.4376) < 1e-3  # both directions count


def test_betweenness_of_a_sample_and_seed(spark):
    g = Graph.from_edgelist(edges(spark, [(i, i + 1) for i in range(12)] + [(0, 6), (3, 9)]))
    assert as_dict(g.betweenness_centrality(sample=4, seed=3)) == as_dict(g.betweenness_centrality(sample=4, seed=3)) != as_dict(g.betweenness_centrality(sample=4, seed=4))


def test_stemmed_search_equals_plain_python(spark):
    import math
    import re

    from brightwater.operators.fts import STOPWORDS
    from brightwater.plans.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    words = {i: [snowball(w) for w in re.split("[^a-z]+", __import__("brightwater.operators.fts", fromlist=["x"]).plain_text(t or "").lower()) if w and w not in STOPWORDS] for i, t in docs.items()}
    mean = sum(map(len, words.values())) / len(docs)
    score = dict.fromkeys(docs, 0.0)
    for term in {snowball("things"), snowball("lasted")}:
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            tf = w.count(term)
            score[i] += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
    want = sorted(((-v, i) for i, v in score.items() if v))[:20]
    got = QUERIES["fts_stemmed"](spark, "/root/testdata/sf0.001").collect()
    assert [r["doc_id"] for r in got] == [i for _, i in want] and all(abs(r["fts_score"] + w[0]) < 1e-9 for r, w in zip(got, want, strict=True))


def test_attached(monkeypatch):
    a = Attached()
    a.attach("pg", "postgres://h/db", type="postgres")
    monkeypatch.setenv("PW", "s3cret")
    a.create_secret("s", type="postgres", user="u", password_env="PW", junk=1)
    assert a.jdbc_options("pg", "t") == {"url": "jdbc:postgresql://h/db", "dbtable": "t", "driver": "org.postgresql.Driver", "user": "u", "password": "s3cret"}
    assert a.list_attached() == [{"name": "pg", "type": "postgres", "path": "postgres://h/db"}]
    a.create_secret("b", type="s3", key_id="k", secret="x", region="r")
    assert a.hadoop_conf("b") == {"fs.s3a.access.key": "k", "fs.s3a.secret.key": "x", "fs.s3a.endpoint.region": "r"}
    a.drop_secret("b")
    assert a.table_name("ice", "s.t", version=3) == "`ice`.`s`.`t` VERSION AS OF 3" and len(a.hash_predicates("id", 4)) == 4
    a.detach("pg")
    with pytest.raises(ValueError):
        a.detach("pg")
    with pytest.raises(ValueError):
        a.attach("x", "y", type="oracle")
    assert ATTACHED.list_attached() == []


def test_session_limits():
    for bad in ({"memory_limit": "lots"}, {"temp_directory": "rel/path"}, {"temp_directory": "/a'; DROP"}):
        with pytest.raises(ValueError):
            session(**bad)


def test_set_operations_and_broadcast(spark):
    from brightwater import should_broadcast

    a, b = Frame(spark.range(5)), Frame(spark.range(3, 8))
    assert a.union_distinct(b).n_rows() == 8 and a.intersect(b).n_rows() == 2 and a.except_(b).n_rows() == 3
    assert should_broadcast(a) and not should_broadcast(a, 1)
    assert a.broadcast_join(b, "id", threshold=1).n_rows() == 2
    assert a.rollup("id", n="count(*)").n_rows() == 6 and a.mutate(p=F.lit(1)).cube("id", "p", n="count(*)").n_rows() == 12


def test_data_sets(spark, tmp_path):
    from brightwater.sources import datasets

    (tmp_path / "penguins.csv").write_text("species,mass\nA,NA\nB,3\n")
    (tmp_path / "karate_club.csv").write_text("src,dst\n1,2\n2,3\n1,3\n")
    assert sorted(datasets.load(spark, "penguins", str(tmp_path)).to_columns()["mass"], key=str) == [3, None]
    g = datasets.karate_club(spark, str(tmp_path))
    assert g.vertex_count() == 34 and g.edge_count() == 6 and g.triangle_count() == 1
    with pytest.raises(ValueError):
        datasets.load(spark, "moons", str(tmp_path))


def test_streaming_verbs(spark, tmp_path):
    from brightwater.streaming import run_available, stream_parquet

    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(str(tmp_path / "in"))
    f = stream_parquet(spark, str(tmp_path / "in"), "id long, k long").filter(col("id") > 2).group_by("k").summarise(n="count(*)")
    run_available(f, "stream_t")
    assert sorted(map(tuple, spark.table("stream_t").collect())) == [(0, 3), (1, 2), (2, 2)]
