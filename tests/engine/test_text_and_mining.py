import hashlib
import hmac
import re

from pyspark.sql import functions as F

from evidentia.functions import exprs
from evidentia.functions import text as X
from evidentia.operators import mining


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_spans_have_code_point_places(spark):
    text = "Every time it crashes \U0001f600 we copy-paste; every time! Manually."
    for _, _, _, pattern in X.EVIDENCE_RULES:
        got = [(s.start, s.end, s.matched) for s in one(spark, X.spans(F.col("t"), pattern), t=text)]
        assert got == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text, re.I)]


def test_tokens(spark):
    got = one(spark, X.tokens(F.col("t")), t="Crashes when INSTALLING pkg-1.2 on windows 11; the error should be installing _x_ v2.")
    assert got == ["crash", "install", "pkg-1.2", "windows", "the"]


def test_repository_references(spark):
    want = {
        "git@github.com:Foo/Bar.git": ("foo/bar", "github_scp_url"), "github:Foo/bar": ("foo/bar", "github_shorthand"), "git+https://github.com/a/b.git": ("a/b", "github_https_url"),
        "ssh://git@github.com/a/b": ("a/b", "github_ssh_url"), "git://github.com/a/b.git": ("a/b", "github_git_url"), "https://github.com/a/b/c": None, "https://gitlab.com/a/b": None,
        "github:a": None, "https://github.com/a/b/": ("a/b", "github_https_url"),
    }
    df = spark.createDataFrame([(k,) for k in want], "v string").select("v", X.repository_reference(F.col("v")).alias("r"))
    assert {r.v: tuple(r.r) if r.r else None for r in df.collect()} == want


def test_relevance(spark):
    call = lambda title, body="": one(spark, X.search_relevant(F.col("t"), F.col("b"), F.lit(False), F.lit(1), "invoice tool"), t=title, b=body)
    assert not call("Invoice software market report 2026: market size")
    assert call("Invoice export fails with error")
    assert not call("Release notes", "an invoice bug was fixed")


def test_digests(spark):
    assert one(spark, exprs.hmac_sha256(b"key", F.col("m")), m="msg é") == hmac.new(b"key", "msg é".encode(), hashlib.sha256).hexdigest()
    assert one(spark, exprs.digest(F.lit("a"), F.lit(None)), t=1) == hashlib.sha256(b"a|None").hexdigest()
    assert one(spark, exprs.canonical_json(F.from_json(F.lit('{"b":"1","a":"2"}'), "map<string,string>")), t=1) == '{"a":"2","b":"1"}'


def test_html(spark):
    assert one(spark, X.html_text(F.col("h")), h="<p>a &amp; b</p><!-- no --><div>c<br/>d</div><h5>e</h5> \t f") == "a & b\n\nc\n\nd\ne f"


def test_problem_reports(spark):
    df = spark.createDataFrame([(1, "App is broken", "daily", ["Type Bug"]), (2, "All fine", "error here", []), (3, " ", "x", ["bug"])], "doc_id long, title string, body string, labels array<string>")
    got = {(r.doc_id, r.rule) for r in mining.evidence(df).collect()}
    assert got == {(1, "problem_report"), (1, "frequency_repeated"), (3, "problem_report")}
    more = spark.createDataFrame([(1, "App is broken", 5, False), (2, "App is broken", None, False), (3, "", 5, False), (4, "App is broken", 5, True)], "doc_id long, title string, entity_id int, is_bot boolean")
    assert [r.doc_id for r in mining.evidence(more, fields=("title",)).collect()] == [1]


def test_similarity_join_is_exact_and_stars_cover(spark):
    import random

    r = random.Random(1)
    sets = [(str(i), r.sample("abcdefghij", r.randrange(2, 7))) for i in range(60)]
    df = spark.createDataFrame(sets, "id string, s array<string>")
    got = {(x.a, x.b) for x in mining.similar_pairs(df, "id", "s").collect()}

    def alike(a, b):
        a, b = set(a), set(b)
        return a == b or (len(a & b) >= 2 and round(len(a & b) / len(a | b), 6) >= 0.6)

    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and alike(x, y)}
    items = df.withColumn("h", F.sha2("id", 256)).withColumn("part", F.lit("p"))
    cover = mining.star_clusters(items, "id", "s", "h", "part").collect()
    assert sorted(x.id for x in cover) == sorted(i for i, s in sets if len(s) >= 3)
    assert {(x.id, x.representative) for x in cover} == greedy(sets)


def greedy(sets):
    """One representative after the other."""
    import hashlib

    sets = {i: frozenset(s) for i, s in sets if len(s) >= 3}
    sim = {i: {j: round(1e6 * (1.0 if a == b else round(len(a & b) / len(a | b), 6))) for j, b in sets.items() if j != i and (a == b or len(a & b) >= 2)} for i, a in sets.items()}
    left, out = set(sets), set()
    while left:
        rank = lambda i: (sum(v >= 600_000 for j, v in sim[i].items() if j in left), sum(v for j, v in sim[i].items() if j in left), hashlib.sha256(i.encode()).hexdigest())
        best = max(left, key=rank)
        star = {best} | {j for j, v in sim[best].items() if j in left and v >= 600_000}
        out |= {(j, best) for j in star}
        left -= star
    return out


def test_clusters_are_described(spark):
    members = spark.createDataFrame([("p", "1", "1", 1.0), ("p", "2", "1", 0.8), ("p", "3", "3", 1.0)], "slice string, id string, representative string, similarity double")
    items = spark.createDataFrame([(1, "Main text", ["a", "b", "c"], "h2", "x", 10, 5), (2, "Other", ["b", "a"], "h1", "y", 11, 3), (3, "Alone", ["q"], "h3", "x", 12, None)], "id int, text string, s array<string>, h string, entity string, document int, at int")
    got = {r.cluster: r for r in mining.describe_clusters(members, items).collect()}
    one, three = got["1"], got["3"]
    assert (one.members, one.entities, one.cohesion_min, one.cohesion_mean, one.first_at, one.last_at) == (2, 2, 0.8, 0.9, 3, 5)
    assert (one.label, one.signature, one.status) == ("Main text", "a,b", "cross_entity_candidate") and one.fingerprint == hashlib.sha256(b"h1|h2").hexdigest()
    assert three.status == "insufficient_repetition" and three.first_at is None


def test_star_golden(spark):
    titles = ["Package setup failed to install windows", "Windows package install fails setup", "Dark theme missing everywhere"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "id string, t string").withColumn("s", X.tokens(F.col("t"))).withColumn("h", F.sha2("id", 256)).withColumn("part", F.lit("p"))
    rows = mining.star_clusters(df, "id", "s", "h", "part").collect()
    groups = {}
    for x in rows:
        groups.setdefault(x.representative, []).append(x)
    assert sorted(map(len, groups.values())) == [1, 2]
    assert all(x.similarity == 1.0 for g in groups.values() for x in g)
    assert sorted(sorted(x.id for x in g) for g in groups.values()) == [["0", "1"], ["2"]]


def test_copies_are_joined_once(spark):
    """Copies of two like sets and of an empty one: every pair of rows comes out, but sets meet once a class and not for copies."""
    rows = [(i, ["a", "b", "c", "d"]) for i in range(30)] + [(i, ["d", "c", "b", "a", "e"]) for i in range(30, 50)] + [(60, ["z"]), (61, ["z"]), (62, []), (63, ["y", "z"])]
    found = mining.similar_pairs(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s")
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.a, r.b, r.shared, r.similarity) for r in found.collect())
    want = [(a, b, 4 if a < 30 else 5, 1.0 if (a < 30) == (b < 30) else 0.8) for a in range(50) for b in range(a + 1, 50)]
    assert got == [*want, (60, 61, 1, 1.0)]


def test_sets_that_share_tokens_but_are_not_alike_are_not_dealt_out(spark):
    """Sets over a small vocabulary: every rare token is in many, so pairs that meet are thousands and similar ones are few."""
    import random

    def written():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    r = random.Random(3)
    sets = [(i, r.sample([f"w{k}" for k in range(60)], 10)) for i in range(600)]
    sets += [(1000 + i, [*s[:8], "other", "more"][: 8 + i % 3]) for i, s in sets[::20]] + [(2000, ["w1", "w2"]), (2001, ["w1", "w2", "w3"]), (2002, ["w9"])]
    before = written()
    found = mining.similar_pairs(spark.createDataFrame(sets, "id long, s array<string>").repartition(4), "id", "s")
    got = sorted((x.a, x.b, x.shared, x.similarity) for x in found.collect())
    want = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            n = len(set(x) & set(y))
            if n >= 2 and round(n / len(set(x) | set(y)), 6) >= 0.6:
                want.append((a, b, n, round(n / len(set(x) | set(y)), 6)))
    assert got == sorted(want) and len(got) >= 30
    assert written() - before < 30 * len(sets)
