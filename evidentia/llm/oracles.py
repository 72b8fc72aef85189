"""SQL that says the same as five of the queries, for DuckDB over the driver's tables.

The others have none: SQL has no sentencepiece, no alignment, no training and no iteration to a settled state.
"""

from __future__ import annotations

from evidentia.llm import divergence, near_dedup, substring_dedup, top_vectors, url_filter

WORDS = r"list_filter(string_split_regex(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x<>'')"


def substring_sql(window: int = substring_dedup.WINDOW) -> str:
    """All windows of all texts by their words, the places of those met twice, and the words that they leave."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
 g AS (SELECT r, i, md5(array_to_string(w[i:i+{window - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w)-{window - 2})) AS i FROM d)),
 t AS (SELECT h FROM g GROUP BY 1 HAVING count(*)>1), c AS (SELECT DISTINCT r, unnest(range(i, i+{window})) AS i FROM g WHERE h IN (SELECT h FROM t)),
 n AS (SELECT r, count(*) AS n_removed FROM c GROUP BY 1),
 s AS (SELECT r, count(*) AS n_spans FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM c) WHERE p IS NULL OR p<>i-1 GROUP BY 1),
 u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w)+1)) AS i FROM d),
 k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN c ON c.r=u.r AND c.i=u.i WHERE c.i IS NULL GROUP BY 1)
 SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed,0)::bigint AS n_removed, sha256(coalesce(kept,'')) AS kept_sha256, coalesce(n_spans,0)::bigint AS n_spans
 FROM d LEFT JOIN n ON n.r=d.r LEFT JOIN s ON s.r=d.r LEFT JOIN k ON k.r=d.r"""


def near_sql(threshold: float = near_dedup.THRESHOLD, size: int = near_dedup.SHINGLE) -> str:
    """Every pair of distinct texts that share a labelled shingle, and the components of those that are alike."""
    return f"""WITH RECURSIVE d AS (SELECT text, min(doc_id) AS c, {WORDS} AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
 g AS (SELECT c, md5(array_to_string(w[i:i+{size - 1}], ' ')) AS h FROM (SELECT c, w, unnest(range(1, greatest(len(w)-{size - 2}, least(len(w),1)+1))) AS i FROM d)),
 m AS (SELECT c, h, row_number() OVER (PARTITION BY c, h) AS nth FROM g), n AS (SELECT c, count(*) AS n FROM m GROUP BY 1),
 p AS (SELECT a.c AS a, b.c AS b, count(*) AS s FROM m a JOIN m b ON a.h=b.h AND a.nth=b.nth AND a.c<b.c GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.c=a JOIN n y ON y.c=b WHERE s >= {threshold}*(x.n+y.n-s)), adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach(c, o) AS (SELECT a, b FROM adj UNION SELECT reach.c, adj.b FROM reach JOIN adj ON adj.a=reach.o), k AS (SELECT c, least(c, min(o)) AS o FROM reach GROUP BY 1)
 SELECT doc_id, coalesce(d.c, doc_id) AS class_id, coalesce(k.o, d.c, doc_id) AS group_id FROM documents LEFT JOIN d ON d.text=documents.text LEFT JOIN k ON k.c=d.c"""


def _url_level(k: int) -> str:
    u = url_filter
    keys = "host, above"
    sums = "sum(pages) AS pages, sum(blocked) AS blocked, sum(allowed) AS allowed"
    df = "greatest(shapes-1,1)::double"
    critical = f"{df}*pow(1-2/(9*{df})+2.326348*sqrt(2/(9*{df})),3)"
    return f""",
 c{k} AS (SELECT host, path[1:{k - 1}] AS above, path[{k}] AS branch, array_to_string(list_transform(path[{k + 1}:], lambda s: CASE WHEN s='*' THEN '*' ELSE 'c' END),'/') AS shape, {sums} FROM t{k - 1} WHERE len(path)>={k} AND path[{k}]<>'*' GROUP BY ALL),
 n{k} AS (SELECT {keys}, count(DISTINCT branch) AS fan, count(DISTINCT shape) AS shapes, sum(pages)::double AS ap, sum(blocked)::double AS ab, sum(allowed)::double AS aa FROM c{k} GROUP BY ALL HAVING count(DISTINCT branch)>1),
 f{k} AS (SELECT {keys}, shape, sum(pages)::double AS of_shape FROM c{k} GROUP BY ALL),
 b{k} AS (SELECT c.host, c.above, branch, sum(pages)::double AS p, sum(blocked)::double AS b, sum(allowed)::double AS a, sum(pages*pages/of_shape) AS parts FROM c{k} c JOIN f{k} f ON f.host=c.host AND f.above=c.above AND f.shape=c.shape GROUP BY ALL),
 j{k} AS (SELECT b.*, fan, shapes, ap, ab, aa, b+a AS seen, ab+aa-b-a AS others, round(ap/p*ap/(ap-p)*(parts-p*p/ap),6) AS chi FROM b{k} b JOIN n{k} n ON n.host=b.host AND n.above=b.above),
 q{k} AS (SELECT host, above, branch, CASE WHEN fan>{u.FANOUT} AND ap<{u.REPEATS}*fan THEN '*' WHEN (shapes=1 OR chi<={critical}) AND CASE WHEN seen>={u.LEAST_LABELLED} AND others>={u.LEAST_LABELLED}
   THEN round(abs(b/seen-(ab-b)/others) - {u.Z}*sqrt(ab/(seen+others)*(1-ab/(seen+others))*(1/greatest(seen,1)+1/greatest(others,1))),9)<=0 ELSE seen>={u.LEAST_LABELLED} OR NOT (ab>={u.LEAST_LABELLED} AND aa>={u.LEAST_LABELLED}) END THEN '~' END AS turn FROM j{k}),
 r{k} AS (SELECT * FROM (SELECT *, count(turn) OVER (PARTITION BY host, above) AS turns FROM q{k}) WHERE turn IS NOT NULL AND turns>1),
 t{k} AS (SELECT t.host, segments, CASE WHEN turn IS NULL THEN path ELSE list_concat(list_concat(path[1:{k - 1}], [turn]), path[{k + 1}:]) END AS path, pages, blocked, allowed FROM t{k - 1} t LEFT JOIN r{k} r ON r.host=t.host AND len(path)>={k} AND r.above=path[1:{k - 1}] AND r.branch=path[{k}])"""


def url_sql(rules=url_filter.RULES, depth: int = url_filter.DEPTH) -> str:
    """The rules, then the tree of templates, a few tables a level."""
    u = url_filter
    rule, verdict = "NULL", "NULL"
    for name, word in sorted(rules, key=lambda r: len(r[0])):
        host, _, rest = name.partition("/")
        fits = f"((host='{host}' OR ends_with(host,'.{host}')) AND starts_with(path,'/{rest}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{name}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{word}' ELSE {verdict} END"
    smooth = lambda b, n, prior: f"(({b}+{u.SMOOTHING}*{prior})/({n}+{u.SMOOTHING}))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH g AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1),'') AS path FROM pages),
 d AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled, list_transform(list_filter(string_split(path,'/'), lambda s: s<>''), lambda s: CASE WHEN regexp_matches(s,'[0-9]') OR length(s)>{u.LONG} THEN '*' ELSE s END) AS segments FROM g),
 t0 AS (SELECT host, segments, segments AS path, count(*) AS pages, count(*) FILTER (ruled='block') AS blocked, count(*) FILTER (ruled='allow') AS allowed FROM d WHERE host<>'' GROUP BY ALL){"".join(_url_level(k) for k in range(1, depth + 1))},
 o AS (SELECT {smooth("coalesce(sum(blocked),0)", "coalesce(sum(blocked)+sum(allowed),0)", "0.5")} AS overall FROM t{depth}), h AS (SELECT host, {smooth("sum(blocked)", "(sum(blocked)+sum(allowed))", "max(overall)")} AS prior FROM t{depth}, o GROUP BY 1),
 s AS (SELECT t.host, path, sum(blocked)+sum(allowed) AS labelled, round({smooth("sum(blocked)", "(sum(blocked)+sum(allowed))", "max(prior)")},9) AS pure FROM t{depth} t JOIN h ON h.host=t.host GROUP BY ALL),
 v AS (SELECT t.host, segments, t.path AS template, pure, labelled>={u.LEAST_LABELLED} AND pure>={u.PURITY} AS rejected FROM t{depth} t JOIN s ON s.host=t.host AND s.path=t.path)
 SELECT page_id, d.host, d.path, rule, coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, '/'||array_to_string(template,'/') AS template, round(pure,6) AS template_purity FROM d LEFT JOIN v ON v.host=d.host AND v.segments=d.segments"""


def divergence_sql(least_docs: int = divergence.LEAST_DOCS, top: int = divergence.TOP, scale: int = divergence.SCALE) -> str:
    """Every kept term under every source of its language, and f for all of them."""
    p = f"1+{scale}::hugeint*(%s+2)//(%s+2*v)"
    f = "((%s-%s)*(%s-%s)//(%s+%s))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang,'') AS lang, coalesce(source,'') AS source,
   regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 u AS (SELECT r, lang, source, unnest(w) AS term FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM u GROUP BY ALL),
 k AS (SELECT lang, term, count(*) AS lang_n FROM u GROUP BY ALL HAVING count(DISTINCT r)>={least_docs}), l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
 s AS (SELECT g.lang, g.source, coalesce(sum(c.n),0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT c.* FROM c JOIN k ON k.lang=c.lang AND k.term=c.term) c ON c.lang=g.lang AND c.source=g.source GROUP BY ALL),
 p AS (SELECT s.lang, s.source, k.term, coalesce(c.n,0) AS n, {p % ("coalesce(c.n,0)", "total")} AS p, {p % ("lang_n", "lang_total")} AS q
   FROM s JOIN k ON k.lang=s.lang JOIN l ON l.lang=s.lang LEFT JOIN c ON c.lang=s.lang AND c.source=s.source AND c.term=k.term),
 a AS (SELECT x.lang, x.source, y.source AS item, sum({f % (("x.p", "y.p") * 3)}) AS value FROM p x JOIN p y ON y.lang=x.lang AND y.term=x.term AND y.source<>x.source GROUP BY ALL),
 o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value,0) AS value FROM s x JOIN s y ON y.lang=x.lang AND y.source<>x.source LEFT JOIN a ON a.lang=x.lang AND a.source=x.source AND a.item=y.source
   UNION ALL SELECT lang, source, 'term', term, {f % (("p", "q") * 3)} FROM p WHERE n>0 AND p>q)
 SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part='pair' OR rank<={top}"""


def vectors_sql(k: int = top_vectors.K, every: int = top_vectors.EVERY, scale: int = top_vectors.SCALE) -> str:
    """Every query against every other row."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale}*x::double)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON c.vec_id<>q.vec_id WHERE q.vec_id%{every}=0)
 SELECT query_id, rank::int AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank<={k}"""


ORACLES = {"op1_substring_dedup": substring_sql(), "op3_url_filter": url_sql(), "op7_near_dedup": near_sql(), "op12_divergence": divergence_sql(), "op13_top_vectors": vectors_sql()}
