"""The queries by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions import fingerprints, mail, text
from labelflow.functions.vector import HashingEmbedder
from labelflow.operators import changes, keyed, knn, lifecycle, live, maturity, vote, worklist
from labelflow.operators import registry as reg
from labelflow.operators.index_view import IndexView
from labelflow.operators.progressive import ProgressiveBuild, admitted, batches
from labelflow.plans import views
from labelflow.plans.views import table
from labelflow.schemas import SKIP
from labelflow.sources.paged import PagedSource, stage
from labelflow.sources.shared import new_folder
from labelflow.sources.store import Change, SnapshotStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


# ---- vectors, neighbours, votes ----------------------------------------------------------------------------------

_LABEL = "CASE WHEN label = 9 THEN '__skip__' ELSE 'L' || label END"


def _vectors_sql(shift: float = 0.0) -> str:
    v = f"list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i = label + 1 THEN {shift} ELSE 0 END)" if shift else "embedding::DOUBLE[]"
    return f"""idx AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n, label FROM (SELECT vec_id AS id, {v} AS v, {_LABEL} AS label FROM embeddings)),
    q AS (SELECT * FROM idx WHERE id % {views.QUERY_STEP} = 0),
    sims AS (SELECT q.id AS query_id, i.id AS neighbour_id, i.label, CASE WHEN q.n * i.n = 0 THEN 0 ELSE list_dot_product(q.v, i.v) / (q.n * i.n) END AS similarity
             FROM q, idx i WHERE q.id <> i.id AND q.n > 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS rank FROM sims QUALIFY rank <= 5),
    ok AS (SELECT label FROM idx GROUP BY label HAVING count(*) >= 5),
    scores AS (SELECT query_id, label, sum(similarity) AS score, min(rank) AS first_rank FROM top WHERE label IN (SELECT label FROM ok) GROUP BY ALL),
    won AS (SELECT query_id, first(label ORDER BY score DESC, first_rank) AS label, max(score) AS best, sum(score) AS total FROM scores GROUP BY query_id),
    verdict AS (SELECT q.id AS query_id, coalesce(CASE WHEN total = 0 OR w.label = '__skip__' THEN '' ELSE w.label END, '') AS label,
                CASE WHEN w.label IS NULL OR total = 0 OR w.label = '__skip__' THEN 0 ELSE best / total END AS confidence FROM q LEFT JOIN won w ON w.query_id = q.id),
    acted AS (SELECT *, CASE WHEN label = '' THEN 'no_label' WHEN confidence >= 0.95 THEN 'label' WHEN confidence >= 0.8 THEN 'label_with_review' ELSE 'no_label' END AS action FROM verdict)"""


def _neighbours(spark, sf_dir, shift=0.0):
    index = views.vectors(spark, sf_dir, shift)
    return index, views.queries(index), knn.neighbours_blocked(views.queries(index), index, exclude_self=True)


def _r6(name: str):
    return F.round(name, 6).alias(name)


@query(f"WITH {_vectors_sql()} SELECT query_id, neighbour_id, round(similarity, 6) AS similarity FROM sims")
def cosine_pairs(spark, sf_dir):
    """Every query against every row."""
    index = views.vectors(spark, sf_dir)
    return knn.similarities(views.queries(index), index)


_TOP = f"WITH {_vectors_sql()} SELECT query_id, neighbour_id, label, round(similarity, 6) AS similarity, rank FROM top"


@query(_TOP)
def knn_topk(spark, sf_dir):
    index = views.vectors(spark, sf_dir)
    return knn.neighbours_blocked(views.queries(index), index, exclude_self=True, bare=True).select("query_id", "neighbour_id", "label", _r6("similarity"), "rank")


@query(_TOP)
def knn_topk_blocked(spark, sf_dir):
    return _neighbours(spark, sf_dir)[2].select("query_id", "neighbour_id", "label", _r6("similarity"), "rank")


@query(f"SELECT {_LABEL} AS label, count(*) AS examples FROM embeddings GROUP BY 1 HAVING count(*) >= 5")
def eligible_labels(spark, sf_dir):
    return vote.eligible_labels(views.vectors(spark, sf_dir))


@query(f"WITH {_vectors_sql()} SELECT query_id, label, round(score, 6) AS score, first_rank FROM scores")
def vote_scores(spark, sf_dir):
    index, _, near = _neighbours(spark, sf_dir)
    return vote.vote_scores(vote.eligible_neighbours(near, index)).select("query_id", "label", _r6("score"), "first_rank")


@query(f"WITH {_vectors_sql()} SELECT query_id, CASE WHEN total = 0 THEN '' ELSE label END AS label, round(CASE WHEN total = 0 THEN 0 ELSE best / total END, 6) AS confidence FROM won")
def vote_confidence(spark, sf_dir):
    index, _, near = _neighbours(spark, sf_dir)
    return vote.vote_confidence(vote.vote_scores(vote.eligible_neighbours(near, index))).select("query_id", "label", _r6("confidence"))


def _classified(spark, sf_dir, shift):
    index, q, near = _neighbours(spark, sf_dir, shift)
    return vote.classify(q, index, near)


@query(f"WITH {_vectors_sql()} SELECT query_id, label, round(confidence, 6) AS confidence, action FROM acted")
def classify(spark, sf_dir):
    return _classified(spark, sf_dir, 0.0).select("query_id", "label", _r6("confidence"), "action")


@query(f"WITH {_vectors_sql(0.5)} SELECT query_id, label, round(confidence, 6) AS confidence, action FROM acted")
def classify_shifted(spark, sf_dir):
    """As classify, with vectors drawn towards their label's axis, so that every action occurs."""
    return _classified(spark, sf_dir, 0.5).select("query_id", "label", _r6("confidence"), "action")


_REGISTRY = "reg AS (SELECT 'L' || i AS label_id, 'name' || i AS label_name, i = 5 AS is_excluded FROM range(6) t(i))"


@query(f"WITH {_vectors_sql(0.5)} SELECT query_id, label, action, action IN ('label', 'label_with_review') AND label IN ('L0', 'L1', 'L2', 'L3', 'L4') AS applied FROM acted")
def apply_gate(spark, sf_dir):
    known = views.registry(spark).withColumn("label_name", F.col("label_id"))
    return vote.apply_gate(_classified(spark, sf_dir, 0.5), known).select("query_id", "label", "action", "applied")


@query("SELECT c_custkey, (abs(c_acctbal) % 100) / 100 AS confidence, CASE WHEN (abs(c_acctbal) % 100) / 100 >= 0.95 THEN 'label' WHEN (abs(c_acctbal) % 100) / 100 >= 0.8 THEN 'label_with_review' ELSE 'no_label' END AS action FROM customer")
def decide_action(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", ((F.abs("c_acctbal") % 100) / 100).alias("confidence"))
    return c.withColumn("action", vote.decide_action(F.col("confidence")))


@query(f"""WITH {_vectors_sql(0.5)}, t AS (SELECT a.*, i.label AS truth FROM acted a JOIN idx i ON i.id = a.query_id)
    SELECT truth, count(*) AS total, count_if(action <> 'no_label')::BIGINT AS labelled, count_if(action <> 'no_label' AND label = truth)::BIGINT AS correct,
    round(count_if(action <> 'no_label' AND label = truth) / nullif(count_if(action <> 'no_label'), 0), 6) AS precision, round(count_if(action <> 'no_label') / count(*), 6) AS coverage FROM t GROUP BY ROLLUP (truth)""")
def evaluation_rollup(spark, sf_dir):
    """Extension: precision and coverage per label and overall."""
    index, q, near = _neighbours(spark, sf_dir, 0.5)
    t = vote.classify(q, index, near).join(index.select(F.col("id").alias("query_id"), F.col("label").alias("truth")), "query_id")
    done, right = F.count_if(F.col("action") != "no_label"), F.count_if((F.col("action") != "no_label") & (F.col("label") == F.col("truth")))
    return t.rollup("truth").agg(F.count(F.lit(1)).alias("total"), done.alias("labelled"), right.alias("correct"), F.round(F.try_divide(right, done), 6).alias("precision"), F.round(done / F.count(F.lit(1)), 6).alias("coverage"))


# ---- stored state ------------------------------------------------------------------------------------------------

_STATE = f"""lab AS (SELECT doc_id AS message_id, CASE WHEN quality = 0 THEN '{SKIP}' ELSE 'T' || toxic END AS label_id, CASE WHEN quality = 0 THEN '{SKIP}' WHEN toxic = 0 THEN 'clean' ELSE '' END AS label_name,
    CASE WHEN quality = 0 THEN 'auto' ELSE 'user' END AS source FROM labels), emb AS (SELECT vec_id AS message_id FROM embeddings),
    joined AS (SELECT l.*, CASE WHEN label_id = '{SKIP}' THEN label_id ELSE coalesce(nullif(label_name, ''), label_id) END AS index_label FROM emb e JOIN lab l USING (message_id))"""


def _state(spark, sf_dir):
    return views.state_vectors(spark, sf_dir), views.state_labels(spark, sf_dir)


@query(f"WITH {_STATE} SELECT j.message_id, len(e.embedding) AS dimension, round(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)), 5) AS total, index_label FROM joined j JOIN embeddings e ON e.vec_id = j.message_id")
def index_join(spark, sf_dir):
    j = keyed.index_join(*_state(spark, sf_dir))
    return j.select("message_id", F.size("vector").cast("bigint").alias("dimension"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), "index_label")


@query(f"WITH {_STATE} SELECT index_label AS label, count(*) AS examples FROM joined GROUP BY 1")
def index_label_counts(spark, sf_dir):
    return keyed.index_label_counts(*_state(spark, sf_dir))


@query(f"WITH {_STATE} SELECT count_if(label_id <> '{SKIP}')::BIGINT AS n_train, count_if(label_id = '{SKIP}')::BIGINT AS n_skip, count(*) AS n_total FROM joined")
def assembly_stats(spark, sf_dir):
    return keyed.assembly_stats(*_state(spark, sf_dir))


@query(f"WITH {_STATE} SELECT message_id FROM emb WHERE message_id NOT IN (SELECT message_id FROM lab)")
def orphan_embeddings(spark, sf_dir):
    e, l = _state(spark, sf_dir)
    return e.join(l, "message_id", "left_anti").select("message_id")


@query(f"WITH {_STATE} SELECT message_id, label_id FROM lab WHERE message_id NOT IN (SELECT message_id FROM emb)")
def orphan_labels(spark, sf_dir):
    e, l = _state(spark, sf_dir)
    return l.join(e, "message_id", "left_anti").select("message_id", "label_id")


@query(f"WITH {_STATE} SELECT DISTINCT label_name FROM lab WHERE label_id <> '{SKIP}' AND label_name IS NOT NULL")
def label_names(spark, sf_dir):
    return keyed.label_names(views.state_labels(spark, sf_dir))


@query(f"WITH {_STATE} SELECT message_id, label_name FROM lab WHERE label_id <> '{SKIP}' AND label_name IN ('clean', '')")
def ids_by_label(spark, sf_dir):
    """Messages under each of the stored names."""
    labels = views.state_labels(spark, sf_dir)
    return keyed.ids_by_label(labels, keyed.label_names(labels))


@query("SELECT doc_id AS message_id, coalesce(len(embedding), 0)::BIGINT AS dimension, coalesce(round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5), 0) AS total FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vector_lookup(spark, sf_dir):
    """The vector of every document; dimension 0 and total 0 where there is none."""
    found = keyed.vectors_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id")), views.state_vectors(spark, sf_dir))
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5)
    size = F.when(F.col("vector").isNull(), 0).otherwise(F.size("vector")).cast("bigint")
    return found.select("message_id", size.alias("dimension"), F.coalesce(total, F.lit(0.0)).alias("total"))


@query(f"WITH {_STATE} SELECT doc_id AS message_id, coalesce(doc_id IN (SELECT message_id FROM joined), false) AS indexed FROM documents")
def index_membership(spark, sf_dir):
    return keyed.membership(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id")), *_state(spark, sf_dir))


@query(f"WITH {_STATE} SELECT message_id FROM lab WHERE label_id = '{SKIP}'")
def skip_vote_ids(spark, sf_dir):
    return views.state_labels(spark, sf_dir).where(F.col("label_id") == SKIP).select("message_id")


@query(f"WITH {_STATE} SELECT index_label AS label, count(*) AS examples, (SELECT count(*) FROM joined WHERE index_label = '{SKIP}') AS skip FROM joined WHERE index_label <> '{SKIP}' GROUP BY 1")
def index_counts(spark, sf_dir):
    return maturity.split_counts(keyed.index_join(*_state(spark, sf_dir)).select(F.col("index_label").alias("label")))


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def label_state_lww(spark, sf_dir):
    """Last write wins per key."""
    return keyed.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id")
def pending_first_wins(spark, sf_dir):
    """First write wins per key."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return keyed.insert_ignore(c.where("false"), c.withColumn("seq", F.col("turn")), "conv_id")


@query("""WITH d AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS source FROM events GROUP BY 1)
    SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, source FROM d""")
def upsert_merge(spark, sf_dir):
    """documents' sources with the last event type of users of that id in their place."""
    base = table(spark, sf_dir, "documents").select("doc_id", "source")
    delta = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"))
    return keyed.upsert(base, delta, "doc_id")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'renamed' ELSE source END AS source FROM documents WHERE source NOT IN ('src2', 'src3')")
def rename_and_purge(spark, sf_dir):
    """Rows of two names deleted, one name changed."""
    base = table(spark, sf_dir, "documents").select("doc_id", "source")
    gone = values(spark, [("src2",), ("src3",)], "source string")
    return keyed.rename(keyed.delete(base, gone, "source"), F.lit("src1"), F.lit("renamed"), "source")


# ---- text --------------------------------------------------------------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip_sql(x: str, left: bool = True) -> str:
    out = f"regexp_replace({x}, '{_WS}+$', '')"
    return f"regexp_replace({out}, '^{_WS}+', '')" if left else out


def _lines_sql(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{_ENDS}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def _html_sql() -> str:
    x = r"regexp_replace(coalesce(html, ''), 'data:[^;]+;base64,[A-Za-z0-9+/=]+', '', 'g')[:200000]"
    for tag in ("head", "style", "script"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    for p in ("(?s)<!--.*?-->", "<[!/?a-zA-Z][^>]*>"):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    for name, char in text.ENTITIES.items():
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{name}', '{quoted}')"
    return f"regexp_replace({x}, ' +', ' ', 'g')"


_HTML = f"SELECT page_id, coalesce(array_to_string(list_filter(list_transform({_lines_sql('x')}, lambda y: {_strip_sql('y')}), lambda y: y <> ''), chr(10)), '') AS text FROM (SELECT page_id, {_html_sql()} AS x FROM pages)"


@query(_HTML)
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query()
def strip_html_parsed(spark, sf_dir):
    """By a parser; SQL has none."""
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html_parsed(F.col("html")).alias("text"))


_URI = "'<img src=\"data:image/png;base64,' || to_base64(encode(url)) || '\">'"


@query(f"""SELECT page_id, CASE WHEN b < a THEN 'html ' || (a // 1024) || 'KB -> ' || (b // 1024) || 'KB before parse' END AS note FROM (
    SELECT page_id, length(h) AS a, least(length(regexp_replace(h, 'data:[^;]+;base64,[A-Za-z0-9+/=]+', '', 'g')), 200000) AS b FROM (SELECT page_id, html || CASE WHEN page_id % 2 = 0 THEN {_URI} ELSE '' END AS h FROM pages))""")
def html_cap_note(spark, sf_dir):
    """Every other page has an inline image appended."""
    # Spark breaks base64 into lines of 76 characters; an image in a page has none.
    image = F.concat(F.lit('<img src="data:image/png;base64,'), F.translate(F.base64(F.col("url").cast("binary")), "\r\n", ""), F.lit('">'))
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.html_cap_note(F.concat("html", F.when(F.col("page_id") % 2 == 0, image).otherwise(""))).alias("note"))


def _with_tail(spark, sf_dir, tails: list[str]):
    """Whole documents with one of the tails, by doc_id."""
    d = table(spark, sf_dir, "documents")
    tail = F.lit("")
    for i, t in enumerate(tails):
        tail = F.when(F.col("doc_id") % (len(tails) + 1) == i, F.lit(t)).otherwise(tail)
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("t"))


def _tail_sql(tails: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, t in enumerate(tails))
    return f"d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % {len(tails) + 1} {cases} ELSE '' END AS t FROM documents)"


_QUOTES = ["\nOn Mon, Jan 1, 2025, John wrote:\n> quoted", "\n\n> quoted\nand more", "\n  \n"]
_FORWARDS = ["\n\n---------- Forwarded message ----------\nFrom: a", " \n", "\n----- Forwarded message -----"]
_SIGNATURES = ["\n\n-- \nJohn", "\nSent from my iPhone", "\n  Sent from my Android phone\nmore", "\nSent from my iPad\n--\nx"]


@query(f"""WITH {_tail_sql(_QUOTES)}, l AS (SELECT doc_id, {_lines_sql('t')} AS ls FROM d),
    p AS (SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '^On .+wrote:$') OR starts_with(x, '>')), true), 0) AS i FROM l)
    SELECT doc_id, regexp_replace(coalesce(array_to_string(CASE WHEN i > 0 THEN ls[:i - 1] ELSE ls END, chr(10)), ''), '(^|\\n){_WS}*\\z', '') AS text FROM p""")
def remove_quoted(spark, sf_dir):
    return _with_tail(spark, sf_dir, _QUOTES).select("doc_id", text.remove_quoted_replies(F.col("t")).alias("text"))


@query(f"WITH {_tail_sql(_FORWARDS)} SELECT doc_id, {_strip_sql("regexp_replace(t, '(?s)\\n*-{5,}\\s*Forwarded message\\s*-{5,}.*', '')", False)} AS text FROM d")
def remove_forwarded(spark, sf_dir):
    return _with_tail(spark, sf_dir, _FORWARDS).select("doc_id", text.remove_forwarded(F.col("t")).alias("text"))


@query(f"""WITH {_tail_sql(_SIGNATURES)}, l AS (SELECT doc_id, t, {_lines_sql('t')} AS ls FROM d),
    p AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: {_strip_sql('x', False)} = '--'), true), 0) AS a,
    coalesce(list_position(list_transform(ls, lambda x: regexp_matches({_strip_sql('x')}, '^(?:{'|'.join(text.MOBILE_SIGNATURES)})')), true), 0) AS b FROM l)
    SELECT doc_id, CASE WHEN a > 0 THEN {_strip_sql("coalesce(array_to_string(ls[:a - 1], chr(10)), '')", False)} WHEN b > 0 THEN {_strip_sql("coalesce(array_to_string(ls[:b - 1], chr(10)), '')", False)} ELSE t END AS text FROM p""")
def trim_signature(spark, sf_dir):
    return _with_tail(spark, sf_dir, _SIGNATURES).select("doc_id", text.trim_signature(F.col("t")).alias("text"))


@query(f"SELECT doc_id, CASE WHEN len(w) <= 400 THEN t ELSE array_to_string(w[:400], ' ') END AS text FROM (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents)")
def truncate_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_words(F.coalesce("text", F.lit(""))).alias("text"))


_BODY = f"""WITH h AS ({_HTML}), f AS (SELECT page_id, {_strip_sql("regexp_replace(text, '(?s)\\n*-{5,}\\s*Forwarded message\\s*-{5,}.*', '')", False)} AS t FROM h),
    ql AS (SELECT page_id, {_lines_sql('t')} AS ls FROM f), qp AS (SELECT page_id, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '^On .+wrote:$') OR starts_with(x, '>')), true), 0) AS i FROM ql),
    q AS (SELECT page_id, regexp_replace(coalesce(array_to_string(CASE WHEN i > 0 THEN ls[:i - 1] ELSE ls END, chr(10)), ''), '(^|\\n){_WS}*\\z', '') AS t FROM qp),
    sl AS (SELECT page_id, t, {_lines_sql('t')} AS ls FROM q),
    sp AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: {_strip_sql('x', False)} = '--'), true), 0) AS a,
      coalesce(list_position(list_transform(ls, lambda x: regexp_matches({_strip_sql('x')}, '^(?:{'|'.join(text.MOBILE_SIGNATURES)})')), true), 0) AS b FROM sl),
    s AS (SELECT page_id, CASE WHEN a > 0 THEN {_strip_sql("coalesce(array_to_string(ls[:a - 1], chr(10)), '')", False)} WHEN b > 0 THEN {_strip_sql("coalesce(array_to_string(ls[:b - 1], chr(10)), '')", False)} ELSE t END AS t FROM sp),
    w AS (SELECT page_id, t, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS ws FROM s)
    SELECT page_id, CASE WHEN len(ws) <= 400 THEN t ELSE array_to_string(ws[:400], ' ') END AS text FROM w"""


@query(_BODY)
def normalise_body(spark, sf_dir):
    """All steps over whole pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.normalise_body(F.col("html")).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<' || source || '@example.com>' ELSE lang || ' <' || source || '@example.com>' END || ' | ' || lang || ' | ' || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' | [list: ' || source || ']' ELSE '' END AS text FROM documents")
def text_representation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.text_representation(F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.concat("source", F.lit("@example.com")), F.col("lang"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) <= 130 THEN text ELSE text[:124] || ' [...]' END AS line FROM documents")
def truncate_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_line(F.col("text")).alias("line"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00 (' || (epoch_us(ts) // 1000) || ' ms)' AS said FROM events")
def format_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.format_ms(F.unix_millis(F.col("ts").cast("timestamp"))).alias("said"))


# ---- mail --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, decode(from_base64(d || repeat('=', (4 - length(d) % 4) % 4))) AS text FROM (SELECT doc_id, translate(rtrim(to_base64(encode(coalesce(text, ''))), '='), '-_', '+/') AS d FROM documents)")
def base64_body(spark, sf_dir):
    """Whole documents through unpadded base64url and back."""
    data = F.rtrim(F.translate(F.translate(F.base64(F.coalesce("text", F.lit("")).cast("binary")), "+/", "-_"), "\r\n", ""), F.lit("="))
    return table(spark, sf_dir, "documents").select("doc_id", mail.decode_base64url(data).alias("text"))


_FROM = "CASE c_custkey % 4 WHEN 0 THEN c_name || ' <u' || c_custkey || '@example.com>' WHEN 1 THEN '\"' || c_mktsegment || ', ' || c_name || '\" <u' || c_custkey || '@example.com>' WHEN 2 THEN 'u' || c_custkey || '@example.com' ELSE '<u' || c_custkey || '@example.com>' END"
_SENDERS = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment || ', ' || c_name ELSE '' END AS name, 'u' || c_custkey || '@example.com' AS address FROM customer"


def _froms(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"""{_FROM.replace('"', chr(92) + '"')} AS h""")


@query(_SENDERS)
def sender_parse(spark, sf_dir):
    return _froms(spark, sf_dir).select("c_custkey", mail.sender(F.col("h")).alias("s")).select("c_custkey", "s.name", "s.address")


@query(_SENDERS)
def sender_parse_fast(spark, sf_dir):
    return _froms(spark, sf_dir).select("c_custkey", mail.sender_fast(F.col("h")).alias("s")).select("c_custkey", "s.name", "s.address")


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS user_text, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS assistant_text FROM conversations GROUP BY conv_id")
def header_extract(spark, sf_dir):
    """Last value of a repeated header, names in any case; a conversation's turns are its headers."""
    c = table(spark, sf_dir, "conversations")
    h = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.initcap("role").alias("name"), F.col("text").alias("value")))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return c.groupBy("conv_id").agg(h.alias("h")).select("conv_id", mail.header(F.col("h"), "USER").alias("user_text"), mail.header(F.col("h"), "assistant").alias("assistant_text"))


@query("SELECT event_id, '' AS email, coalesce(json_extract_string(props, '$.k'), '') AS history_id FROM events")
def notification_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.replace("props", F.lit('"k"'), F.lit('"historyId"')).alias("p"))
    return e.select("event_id", mail.notification(F.col("p")).alias("n")).select("event_id", "n.email", "n.history_id")


_MIME_BODY = "CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '<p>' || source || '</p>' WHEN 2 THEN CASE WHEN coalesce(text, '') = '' THEN lang ELSE text END WHEN 3 THEN coalesce(text, '') ELSE coalesce(text, '') END"


@query(f"SELECT doc_id AS message_id, lang AS subject, source || '@example.com' AS from_address, lang AS from_name, {_MIME_BODY} AS body_html, 'INBOX,' || source AS labels, source AS list_id, '' AS date FROM documents")
def mime_messages(spark, sf_dir):
    """documents as MIME messages of five kinds: nested plain text; HTML beside plain text; an empty HTML part before a
    multipart, with plain text to fall back to; a text leaf alone; several levels."""
    d = table(spark, sf_dir, "documents")
    coded = lambda x: F.regexp_replace(F.replace(F.replace(F.base64(x.cast("binary")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_")), "[\r\n=]+", "")
    leaf = lambda kind, x: F.concat(F.lit(f'{{"mimeType":"{kind}","body":{{"data":"'), coded(x), F.lit('"}}'))
    many = lambda kind, *parts: F.concat(F.lit(f'{{"mimeType":"multipart/{kind}","parts":['), F.concat_ws(",", *parts), F.lit("]}"))
    said, pdf = F.coalesce("text", F.lit("")), F.lit('{"mimeType":"application/pdf"}')
    html = F.concat(F.lit("<p>"), "source", F.lit("</p>"))
    deep = leaf("text/plain", said)
    for kind in ("alternative", "related", "mixed", "signed"):
        deep = many(kind, pdf, deep)
    kinds = [
        many("mixed", many("alternative", leaf("text/plain", said)), pdf), many("alternative", leaf("text/plain", said), many("mixed", leaf("text/html", said)), leaf("text/html", F.lit("first")), leaf("text/html", html)),
        many("mixed", leaf("text/plain", F.lit("no")), many("alternative", leaf("text/html", F.lit("before"))), leaf("text/html", F.lit("")), many("mixed", leaf("text/calendar", F.lit("x"))), many("mixed", leaf("text/plain", said)), leaf("text/plain", F.col("lang"))),
        leaf("text/enriched", said), deep,
    ]
    tree = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        tree = F.when(F.col("doc_id") % 5 == i, k).otherwise(tree)
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    headers = F.array(pair("From", F.concat("lang", F.lit(" <"), "source", F.lit("@example.com>"))), pair("SUBJECT", F.col("lang")), pair("List-Id", F.concat(F.lit("<"), "source", F.lit(">"))))
    raw = d.select(F.col("doc_id").alias("id"), F.array(F.lit("INBOX"), "source").alias("labelIds"), headers.alias("headers"), tree.alias("payload"))
    return mail.parse_messages(raw).withColumn("labels", F.array_join("labels", ","))


# ---- fingerprints ------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey, substr(sha256(string_agg(n_name, chr(10) ORDER BY n_name)), 1, 16) AS hash FROM nation GROUP BY 1")
def excluded_hash(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = F.concat(F.collect_list(F.concat(F.lit(" "), "n_name", F.lit(" "))), F.array(F.lit("  ")))
    return n.groupBy("n_regionkey").agg(fingerprints.excluded_hash(names).alias("hash"))


@query(f"SELECT n_nationkey, 'model=' || n_name || '|dim=' || n_regionkey || '|textrepr-v1|clf=' || substr(sha256('high=0.95|medium=0.8|min_examples=5|skip={SKIP}'), 1, 16) AS fingerprint FROM nation")
def ml_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", fingerprints.ml_fingerprint(F.col("n_name"), F.col("n_regionkey")).alias("fingerprint"))


# ---- change log --------------------------------------------------------------------------------------------------

_HISTORY = f"""{_REGISTRY}, ev AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'messagesAdded' WHEN 'click' THEN 'labelsAdded' ELSE 'labelsRemoved' END AS type, user_id AS message_id,
    CASE event_type WHEN 'signup' THEN 'INBOX' ELSE 'L' || (event_id % 7) END AS label_id FROM events WHERE event_type IN ('signup', 'click', 'error')),
    ch AS (SELECT ev.*, label_name FROM ev JOIN reg USING (label_id) WHERE NOT is_excluded AND type <> 'messagesAdded'),
    sets AS (SELECT message_id, coalesce(list_sort(list(DISTINCT label_id) FILTER (type = 'labelsAdded')), []) AS added, coalesce(list_sort(list(DISTINCT label_id) FILTER (type = 'labelsRemoved')), []) AS removed,
      arg_max(label_id, seq) FILTER (type = 'labelsAdded') AS add_id, arg_max(label_name, seq) FILTER (type = 'labelsAdded') AS add_name, arg_max(label_name, seq) FILTER (type = 'labelsRemoved') AS from_name FROM ch GROUP BY 1),
    outs AS (SELECT s.*, CASE WHEN d.doc_id IS NULL THEN 'gone' WHEN len(added) > 0 THEN 'upsert' WHEN d.doc_id % 3 = 0 THEN 'remove' ELSE 'skip' END AS op FROM sets s LEFT JOIN documents d ON d.doc_id = s.message_id)"""


def _outcomes(spark, sf_dir):
    """documents are the messages; every third still carries the excluded label L5."""
    r = views.registry(spark)
    messages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("L5"), F.lit("INBOX"))).otherwise(F.array(F.lit("INBOX"))).alias("labels"))
    return changes.label_outcomes(changes.change_sets(changes.relevant_changes(views.history(spark, sf_dir), r)), messages, r)


_NEW = f"WITH {_HISTORY} SELECT message_id, min(seq) AS seq FROM ev WHERE type = 'messagesAdded' AND message_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"


@query(_NEW)
def new_inbox_ids(spark, sf_dir):
    seen = views.state_labels(spark, sf_dir)
    return changes.new_inbox_ids(views.history(spark, sf_dir), seen)


@query(f"WITH {_HISTORY} SELECT message_id, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM sets")
def label_change_sets(spark, sf_dir):
    sets = changes.change_sets(changes.relevant_changes(views.history(spark, sf_dir), views.registry(spark)))
    return sets.select("message_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(f"WITH {_HISTORY} SELECT seq, message_id, label_id, type FROM ch WHERE message_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)")
def echo_suppression(spark, sf_dir):
    """Messages that we labelled ourselves are those whose vector has label 0."""
    own = table(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("message_id"))
    left, _ = changes.suppress_echoes(changes.relevant_changes(views.history(spark, sf_dir), views.registry(spark)), own)
    return left.select("seq", "message_id", "label_id", "type")


@query(f"WITH {_HISTORY} SELECT message_id, op, CASE op WHEN 'upsert' THEN add_id WHEN 'skip' THEN '{SKIP}' END AS label_id FROM outs")
def label_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("message_id", "op", "label_id")


@query(f"WITH {_HISTORY} SELECT coalesce(from_name, 'inbox') AS source, CASE op WHEN 'upsert' THEN add_name ELSE 'inbox' END AS destination, count(*) AS n FROM outs WHERE op IN ('upsert', 'skip') GROUP BY 1, 2")
def movements(spark, sf_dir):
    return changes.movements(_outcomes(spark, sf_dir))


_APPLIED = f"""WITH {_HISTORY}, {_STATE} SELECT message_id, label_id, label_name, source FROM lab WHERE message_id NOT IN (SELECT message_id FROM outs)
    UNION ALL SELECT message_id, CASE op WHEN 'upsert' THEN add_id ELSE '{SKIP}' END, CASE op WHEN 'upsert' THEN add_name ELSE '{SKIP}' END, CASE op WHEN 'upsert' THEN 'user' ELSE 'auto' END FROM outs WHERE op IN ('upsert', 'skip')"""


@query(_APPLIED)
def apply_label_changes(spark, sf_dir):
    return changes.apply_outcomes(views.state_labels(spark, sf_dir), _outcomes(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT DISTINCT label_id FROM ev WHERE type <> 'messagesAdded' AND label_id NOT IN (SELECT label_id FROM reg)")
def unknown_labels(spark, sf_dir):
    return changes.unknown_label_ids(views.history(spark, sf_dir), views.registry(spark))


@query("SELECT doc_id AS message_id FROM documents WHERE doc_id % 3 <> 0")
def without_user_label(spark, sf_dir):
    messages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("L5"))).otherwise(F.array(F.lit("INBOX"))).alias("labels"))
    return changes.without_user_label(messages, views.registry(spark)).select("message_id")


@query("SELECT event_id * 1000000 + CASE event_type WHEN 'click' THEN 100000 WHEN 'error' THEN 200000 ELSE 0 END AS seq, CASE event_type WHEN 'click' THEN 'labelsAdded' WHEN 'error' THEN 'labelsRemoved' ELSE 'messagesAdded' END AS type, user_id AS message_id FROM events")
def history_records(spark, sf_dir):
    """Change-log records with three arrays each, flattened in order."""
    e = table(spark, sf_dir, "events")
    item = F.array(F.struct(F.col("user_id").alias("message_id"), F.array(F.lit("INBOX")).alias("label_ids")))
    none = F.filter(item, lambda x: F.lit(False))
    is_ = lambda t: F.col("event_type") == t
    records = e.select(F.col("event_id").alias("id"), F.when(~F.col("event_type").isin("click", "error"), item).otherwise(none).alias("messagesAdded"), F.when(is_("click"), item).otherwise(none).alias("labelsAdded"), F.when(is_("error"), item).otherwise(none).alias("labelsRemoved"))
    return changes.explode_history(records).select("seq", "type", "message_id")


# ---- registry, work list, maturity, lifecycle --------------------------------------------------------------------


@query("SELECT n_nationkey AS label_id, n_name AS old_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name || '_new' END AS new_name, CASE WHEN n_nationkey % 5 = 0 THEN 'deleted' ELSE 'renamed' END AS change FROM nation WHERE (n_nationkey % 5 = 0 AND n_regionkey <> 0) OR (n_nationkey % 5 <> 0 AND n_nationkey % 2 = 0)")
def registry_diff(spark, sf_dir):
    """Nations are labels; every fifth is gone, those of region 0 are excluded, even ones have a new name."""
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_nationkey").alias("label_id"), F.col("n_name").alias("label_name"), (F.col("n_regionkey") == 0).alias("is_excluded"))
    new = n.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("label_id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("_new"))).otherwise(F.col("n_name")).alias("label_name"))
    return reg.registry_diff(old, new)


@query(f"WITH {_STATE} SELECT message_id, CASE label_name WHEN 'clean' THEN '{SKIP}' ELSE label_id END AS label_id, CASE label_name WHEN 'clean' THEN '{SKIP}' WHEN '' THEN 'toxic' ELSE label_name END AS label_name, CASE label_name WHEN 'clean' THEN 'auto' ELSE source END AS source FROM lab")
def reconcile_labels(spark, sf_dir):
    """'clean' is deleted, the unnamed label gets a name."""
    diff = values(spark, [("T0", "clean", None, "deleted"), ("T1", "", "toxic", "renamed")], "label_id string, old_name string, new_name string, change string")
    return reg.reconcile(views.state_labels(spark, sf_dir), diff)[0]


@query("SELECT source AS label_name, 'removed' AS change FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT 'src' || (n_nationkey % 10) FROM nation) UNION ALL SELECT DISTINCT r_name, 'added' FROM region WHERE r_name NOT IN (SELECT source FROM documents)")
def exclusion_reconcile(spark, sf_dir):
    present = table(spark, sf_dir, "documents").select(F.col("source").alias("label_name"))
    included = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (F.col("n_nationkey") % 10).cast("string")).alias("label_name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("label_name")))
    return reg.exclusion_changes(present, included)


@query("SELECT max(length(n_name)) AS width FROM nation WHERE n_regionkey <> 0")
def max_label_width(spark, sf_dir):
    """Nations are labels, those of region 0 excluded."""
    n = table(spark, sf_dir, "nation")
    return reg.max_label_width(n.select(F.col("n_name").alias("label_name"), (F.col("n_regionkey") == 0).alias("is_excluded")))


_WORK = f"""l AS (SELECT o_orderpriority[:1] AS label_id, o_orderkey AS message_id, o_orderdate AS recency, o_orderstatus FROM orders),
    named AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY recency DESC, message_id) AS rn FROM l WHERE o_orderstatus <> 'P' AND label_id <> '5' QUALIFY rn <= 200),
    pool AS (SELECT *, row_number() OVER (ORDER BY recency DESC, message_id) AS rn FROM l WHERE o_orderstatus = 'P' QUALIFY rn <= 200),
    work AS (SELECT message_id, label_id, 'P' || label_id AS label_name, 'user' AS source, 1 AS part, rn AS turn, label_id::INT AS o FROM named UNION ALL
      SELECT message_id, '{SKIP}', '{SKIP}', 'auto', CASE WHEN rn <= 50 THEN 0 ELSE 1 END, CASE WHEN rn <= 50 THEN rn ELSE rn - 50 END, 1 << 30 FROM pool),
    planned AS (SELECT row_number() OVER (ORDER BY part, turn, o, message_id) - 1 AS pos, message_id, label_id, label_name, source FROM work)"""


def _planned(spark, sf_dir):
    """Open orders are unlabelled messages; priority 5 is excluded. The caps are the operator's own."""
    l = views.listing(spark, sf_dir)
    labels = spark.range(1, 5).select(F.col("id").cast("string").alias("label_id"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("label_name"), F.col("id").cast("int").alias("ordinal"))
    drop = lambda df: df.drop("o_orderstatus")
    return worklist.plan(drop(l.where("o_orderstatus <> 'P'")), drop(l.where("o_orderstatus = 'P'")).drop("label_id"), labels)


@query(f"WITH {_WORK} SELECT * FROM planned")
def worklist_round_robin(spark, sf_dir):
    return _planned(spark, sf_dir)


@query(f"WITH {_WORK} SELECT label_name, count(*) AS available FROM planned GROUP BY 1")
def worklist_available(spark, sf_dir):
    return worklist.available_counts(_planned(spark, sf_dir))


@query(f"WITH {_WORK}, p AS (SELECT pos, message_id % 100 AS message_id, label_id FROM planned) SELECT message_id, arg_min(label_id, pos) AS first_label, arg_max(label_id, pos) AS last_label FROM p GROUP BY 1")
def worklist_dedup(spark, sf_dir):
    """First and last place of messages that stand in several buckets (ids folded so that they do)."""
    p = _planned(spark, sf_dir).withColumn("message_id", F.col("message_id") % 100)
    first, last = worklist.first_wins(p), worklist.last_wins(p)
    return first.select("message_id", F.col("label_id").alias("first_label")).join(last.select("message_id", F.col("label_id").alias("last_label")), "message_id")


_GATE = f"avail AS (SELECT {_LABEL} AS label, count(*) AS available FROM embeddings GROUP BY 1), gate AS (SELECT label, least(available, 20) AS target FROM avail WHERE label <> '{SKIP}' AND available >= 5 UNION ALL SELECT '{SKIP}', least(coalesce(sum(available), 0), 50) FROM avail WHERE label = '{SKIP}')"


def _gate(spark, sf_dir):
    return maturity.gate(views.vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("available")))


@query(f"WITH {_GATE} SELECT label, target::BIGINT AS target FROM gate")
def maturity_gate(spark, sf_dir):
    return _gate(spark, sf_dir)


@query(f"WITH {_GATE}, {_STATE}, c AS (SELECT index_label AS label, count(*) AS examples FROM joined GROUP BY 1) SELECT coalesce(bool_and(coalesce(examples, 0) >= target), true) AS open FROM gate LEFT JOIN c USING (label)")
def maturity_open(spark, sf_dir):
    return maturity.is_open(_gate(spark, sf_dir), keyed.index_label_counts(*_state(spark, sf_dir)))


_STARTS = {
    "bootstrap_status": "CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'in_progress' ELSE 'complete' END", "schema_version": "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '2' ELSE '1' END",
    "account_id": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'b' ELSE 'a' END", "want_account": "CASE c_custkey % 13 WHEN 0 THEN '' ELSE 'a' END",
    "fingerprint": "CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'g' ELSE 'f' END", "want_fingerprint": "'f'", "excluded_hash": "CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE 'h' END", "want_excluded_hash": "'h'",
}
_STARTED = "SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in _STARTS.items()) + " FROM customer"


@query(f"""SELECT c_custkey, CASE WHEN coalesce(bootstrap_status, 'in_progress') = 'in_progress' THEN 'BOOTSTRAP' WHEN schema_version <> '1' THEN 'INCOMPATIBLE' WHEN coalesce(account_id, '') = '' OR account_id IS DISTINCT FROM want_account THEN 'INCOMPATIBLE'
    WHEN fingerprint IS DISTINCT FROM want_fingerprint THEN 'REBUILD' WHEN excluded_hash IS DISTINCT FROM want_excluded_hash THEN 'RECONCILE' ELSE 'WARM' END AS decision FROM ({_STARTED})""")
def startup_decision(spark, sf_dir):
    """Customers are stored states of all kinds."""
    states = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{v} AS {k}" for k, v in _STARTS.items()])
    return states.select("c_custkey", lifecycle.startup_decision().alias("decision"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND (event_id - 5000) * 1000 BETWEEN 0 AND 3600000 THEN 'REPLAY' ELSE 'RESYNC' END AS decision FROM events")
def gap_decision(spark, sf_dir):
    """Gaps around the window; some cursors are missing, some times malformed."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.lit("c")).alias("cursor"), F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.lit(10_000_000) - (F.col("event_id") - 5000) * 1000).cast("string")).alias("at"))
    return e.select("event_id", lifecycle.gap_decision(F.col("cursor"), F.col("at"), F.lit(10_000_000)).alias("decision"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE least(least(5 * 2 ** (o_orderkey % 9 - 1), 60) * 2, 60)::INT END AS seconds FROM orders")
def backoff_curve(spark, sf_dir):
    """Orders are restarts after 0 to 8 failures; the wait before was that of one failure less."""
    n = F.col("o_orderkey") % 9
    before = F.when(n == 0, 0).otherwise(F.least(5 * F.pow(F.lit(2), n - 1), F.lit(60))).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", lifecycle.next_backoff(before).cast("int").alias("seconds"))


@query(f"""WITH {_STATE}, want AS (SELECT vec_id AS message_id, 'T' || (label % 2) AS new_id FROM embeddings WHERE label < 5)
    SELECT message_id, coalesce(new_id, l.label_id) AS label_id, CASE WHEN new_id IS NULL THEN 'drop' WHEN e.message_id IS NULL THEN 'embed' WHEN new_id IS NOT DISTINCT FROM l.label_id THEN 'keep' ELSE 'relabel' END AS action
    FROM lab l FULL OUTER JOIN want USING (message_id) LEFT JOIN (SELECT vec_id AS message_id FROM embeddings WHERE label <> 3) e USING (message_id)""")
def resync_snapshot(spark, sf_dir):
    """The snapshot is the vectors of labels below 5; those of label 3 have no stored vector."""
    e = table(spark, sf_dir, "embeddings")
    desired = e.where("label < 5").select(F.col("vec_id").alias("message_id"), F.concat(F.lit("T"), (F.col("label") % 2).cast("string")).alias("label_id"), F.lit("n").alias("label_name"), F.lit("user").alias("source"), F.col("vec_id").alias("pos"))
    return lifecycle.resync_snapshot(views.state_labels(spark, sf_dir), desired, e.where("label <> 3").select(F.col("vec_id").alias("message_id")))


@query("SELECT event_id AS message_id, epoch_us(ts) // 1000000 AS sent_s FROM events WHERE epoch_us(ts) // 1000000 > 1705000000 AND event_id NOT IN (SELECT doc_id FROM labels)")
def gap_ids(spark, sf_dir):
    inbox = table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sent_s"))
    return lifecycle.gap_message_ids(inbox, views.state_labels(spark, sf_dir), 1_705_000_000_000)


@query(f"""WITH {_STATE} SELECT (SELECT count(*) FROM emb) AS n_embeddings, (SELECT count(*) FROM lab) AS n_labels, (SELECT count(*) FROM joined) AS index_size, (SELECT count(*) FROM joined WHERE label_id = '{SKIP}') AS skip_size,
    (SELECT count(DISTINCT index_label) FROM joined WHERE label_id <> '{SKIP}') AS n_names, (SELECT count(DISTINCT conv_id) FROM conversations) AS pending""")
def status_report(spark, sf_dir):
    from labelflow.plans.status import status

    e, l = _state(spark, sf_dir)
    return status(e, l, pending_first_wins(spark, sf_dir))


# ---- live path and batch jobs ---------------------------------------------------------------------------------------

_FRESH = f"""{_HISTORY}, fresh AS (SELECT message_id FROM ev WHERE type = 'messagesAdded' AND message_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1),
    {_vectors_sql(0.5).replace(f"id % {views.QUERY_STEP} = 0", "id IN (SELECT message_id FROM fresh)").replace("sims AS (", "old AS (SELECT * FROM idx WHERE id NOT IN (SELECT id FROM q)), sims AS (").replace("FROM q, idx i", "FROM q, old i")},
    results AS (SELECT query_id AS message_id, label, confidence, action, action IN ('label', 'label_with_review') AND label IN ('L0', 'L1', 'L2', 'L3', 'L4') AS applied FROM acted)"""


def _results(spark, sf_dir):
    """New inbox messages of the change log; a message's vector is that of its id, the index all others."""
    index = views.vectors(spark, sf_dir, 0.5)
    fresh = changes.new_inbox_ids(views.history(spark, sf_dir), views.state_labels(spark, sf_dir))
    known = views.registry(spark).withColumn("label_name", F.col("label_id"))
    by_id = lambda ids: index.select(F.col("id").alias("message_id"), "vector").join(ids.select("message_id"), "message_id", "left_semi")
    return live.classify_new(fresh, index, known, by_id)


@query(f"WITH {_FRESH} SELECT message_id, label, round(confidence, 6) AS confidence, action, applied FROM results")
def process_history(spark, sf_dir):
    """From the change log to verdicts."""
    return _results(spark, sf_dir).select("message_id", "label", _r6("confidence"), "action", "applied")


@query(f"WITH {_FRESH} SELECT message_id, label AS add_label, 'INBOX' AS remove_label FROM results WHERE applied")
def outbox(spark, sf_dir):
    return live.outbox(_results(spark, sf_dir))


@query(f"WITH {_FRESH} SELECT message_id, '{SKIP}' AS label_id, 'auto' AS source FROM results WHERE action = 'no_label'")
def learnt_rejects(spark, sf_dir):
    return live.learnt(_results(spark, sf_dir))[0].select("message_id", "label_id", "source")


@query(f"WITH {_FRESH} SELECT seq, message_id, label_id, type FROM ch WHERE message_id NOT IN (SELECT message_id FROM results WHERE applied)")
def echo_after_outbox(spark, sf_dir):
    """Label changes without those of messages that we labelled."""
    applied = live.outbox(_results(spark, sf_dir))
    return changes.suppress_echoes(changes.relevant_changes(views.history(spark, sf_dir), views.registry(spark)), applied)[0].select("seq", "message_id", "label_id", "type")


_ALIVE = "alive AS (SELECT vec_id AS message_id FROM embeddings WHERE label <> 7)"


def _jobs(spark, sf_dir):
    """Stored labels and vectors (of labels 0 to 2), and an embedder that knows the messages of all labels but 7."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("embedding").alias("vector"), "label")
    alive = e.where("label <> 7")
    return views.state_labels(spark, sf_dir), e.where("label < 3").select("message_id", "vector"), e, lambda ids: alive.join(ids.select("message_id"), "message_id", "left_semi").select("message_id", "vector")


def _with_vectors(labels, vectors):
    return labels.join(vectors.select("message_id", F.lit(True).alias("v")), "message_id", "left").select("message_id", "label_id", "label_name", "source", F.coalesce("v", F.lit(False)).alias("has_vector"))


_WANTED = "want AS (SELECT vec_id AS message_id, 'T' || (label % 2) AS label_id, 'n' AS label_name, 'user' AS source FROM embeddings WHERE label >= 2 AND label <> 7)"


def _wanted(e):
    return e.where("label >= 2").select(F.col("message_id").alias("pos"), "message_id", F.concat(F.lit("T"), (F.col("label") % 2).cast("string")).alias("label_id"), F.lit("n").alias("label_name"), F.lit("user").alias("source"))


@query(f"WITH {_STATE}, {_WANTED}, vec AS (SELECT vec_id AS message_id FROM embeddings WHERE label <> 7) SELECT u.*, u.message_id IN (SELECT message_id FROM vec WHERE message_id IN (SELECT vec_id FROM embeddings WHERE label < 3) OR message_id IN (SELECT message_id FROM want)) AS has_vector FROM (SELECT * FROM want UNION ALL SELECT * FROM lab WHERE message_id NOT IN (SELECT message_id FROM want)) u")
def bootstrap_state(spark, sf_dir):
    """A work list added to the stored labels; messages of label 7 no longer exist."""
    labels, vectors, e, embed = _jobs(spark, sf_dir)
    return _with_vectors(*live.bootstrap(_wanted(e), labels, vectors, embed))


@query(f"WITH {_WANTED} SELECT *, true AS has_vector FROM want")
def resync_applied(spark, sf_dir):
    """The stored labels after a resync to the work list."""
    labels, vectors, e, embed = _jobs(spark, sf_dir)
    return _with_vectors(*live.apply_resync(labels, vectors, _wanted(e), embed))


@query(f"""WITH {_STATE}, {_ALIVE}, new AS (SELECT vec_id AS message_id, 'N' AS label_id, 'new' AS label_name, 'user' AS source FROM embeddings WHERE label = 4),
    u AS (SELECT * FROM new UNION ALL SELECT * FROM lab WHERE label_name <> 'clean' AND message_id NOT IN (SELECT message_id FROM new))
    SELECT u.*, u.message_id IN (SELECT vec_id FROM embeddings WHERE label < 3 OR label = 4) AS has_vector FROM u""")
def exclusions_applied(spark, sf_dir):
    """'clean' is no longer included, 'new' is: its messages are those of label 4."""
    labels, vectors, e, embed = _jobs(spark, sf_dir)
    included = values(spark, [("T1", ""), ("N", "new")], "label_id string, label_name string")
    listing = e.where("label = 4").select(F.col("message_id").alias("pos"), "message_id", F.lit("N").alias("label_id"))
    return _with_vectors(*live.apply_exclusions(labels, vectors, included, listing, embed))


@query(f"WITH {_STATE}, {_ALIVE} SELECT message_id FROM lab WHERE message_id IN (SELECT message_id FROM alive)")
def rebuild_vectors(spark, sf_dir):
    """Which labelled messages a new model has vectors of."""
    labels, _, _, embed = _jobs(spark, sf_dir)
    return live.rebuild(labels, embed).select("message_id")


# ---- stored state: deltas, index view, rebuild, text to vote ---------------------------------------------------------


def _store(spark):
    return SnapshotStore(spark, new_folder(spark, "state"))


def _thirds(events):
    """The events in three parts by their order."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return [events.where((F.col("seq") * 3 > k * last) & (F.col("seq") * 3 <= (k + 1) * last) if k else F.col("seq") * 3 <= last) for k in range(3)]


def _label_change(part):
    """Last click (label added) or error (label removed) of each user in a part, as a change of labels."""
    last = keyed.latest(part.where("type <> 'messagesAdded'").withColumn("message_id", F.col("message_id").cast("string")), "message_id")
    up = last.where("type = 'labelsAdded'").select("message_id", F.col("label_ids")[0].alias("label_id"), F.lit(None).cast("string").alias("label_name"), F.lit("user").alias("source"))
    return Change(up, last.where("type = 'labelsRemoved'"))


_LAST_LABEL = """ev AS (SELECT user_id AS message_id, arg_max(event_type, event_id) AS kind, 'L' || (max(event_id) % 7) AS label_id FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)"""


@query(f"WITH {_LAST_LABEL} SELECT message_id, label_id FROM ev WHERE kind = 'click' UNION ALL SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT message_id FROM ev)")
def store_merge_on_read(spark, sf_dir):
    """documents as a stored table, three commits of deltas by the events, read back merged."""
    store = _store(spark)
    d = table(spark, sf_dir, "documents")
    store.commit({"labels": d.select(F.col("doc_id").cast("string").alias("message_id"), F.col("source").alias("label_id"), F.lit(None).cast("string").alias("label_name"), F.lit("user").alias("source"))})
    for k, part in enumerate(_thirds(views.history(spark, sf_dir))):
        store.commit(changes={"labels": _label_change(part)}, batch_id=k)
    return store.table("labels").select(F.col("message_id").cast("bigint").alias("message_id"), "label_id")


_VIEW = f"""WITH {_STATE}, {_LAST_LABEL}, new_lab AS (SELECT message_id, label_id AS index_label FROM ev WHERE kind = 'click' UNION ALL SELECT message_id, CASE WHEN label_id = '{SKIP}' THEN label_id ELSE coalesce(nullif(label_name, ''), label_id) END FROM lab WHERE message_id NOT IN (SELECT message_id FROM ev)),
    vec AS (SELECT vec_id AS message_id FROM embeddings WHERE label < 5 UNION SELECT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT vec_id FROM embeddings)), v AS (SELECT message_id, index_label FROM new_lab JOIN vec USING (message_id))"""


def _replayed(spark, sf_dir):
    """The index view after a replay of the events: labels change by clicks and errors, vectors come in by signups."""
    view = IndexView(_store(spark))
    e, text_id = table(spark, sf_dir, "embeddings"), lambda c: F.col(c).cast("string").alias("message_id")
    view.store.commit({"embeddings": e.where("label < 5").select(text_id("vec_id"), F.col("embedding").alias("vector")), "labels": views.state_labels(spark, sf_dir).withColumn("message_id", F.col("message_id").cast("string"))})
    for k, part in enumerate(_thirds(views.history(spark, sf_dir))):
        joined = e.join(part.where("type = 'messagesAdded'").select(F.col("message_id").alias("vec_id")).distinct(), "vec_id").select(text_id("vec_id"), F.col("embedding").alias("vector"))
        view.apply({"labels": _label_change(part), "embeddings": Change(joined)}, k)
    return view


@query(_VIEW + " SELECT * FROM v")
def index_view_replay(spark, sf_dir):
    return _replayed(spark, sf_dir).store.table("index_view").select(F.col("message_id").cast("bigint").alias("message_id"), "index_label")


@query(_VIEW + " SELECT index_label AS label, count(*) AS examples FROM v GROUP BY 1")
def index_view_counts(spark, sf_dir):
    """Counts that were kept by signs, not counted."""
    return _replayed(spark, sf_dir).counts()


@query("SELECT doc_id AS message_id, round(list_sum(list_transform(e.embedding, lambda x: 2 * x::DOUBLE)), 4) AS total FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id")
def rebuild_beside(spark, sf_dir):
    """All labelled messages' vectors by a new model (twice the old one's), swapped in together with its fingerprint."""
    store, e = _store(spark), table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("message_id"), "embedding")
    store.commit({"embeddings": e.select("message_id", F.col("embedding").alias("vector")), "labels": views.state_labels(spark, sf_dir).withColumn("message_id", F.col("message_id").cast("string"))})
    live.rebuild_beside(store, lambda ids: e.join(ids.select("message_id"), "message_id", "left_semi").select("message_id", F.transform("embedding", lambda x: (2 * x).cast("float")).alias("vector")), "f2")
    return store.table("embeddings").select(F.col("message_id").cast("bigint").alias("message_id"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


_TEXT_VECTORS = f"""body AS ({_BODY}), said AS (SELECT page_id, regexp_extract_all(lower('page <' || page_id || '@example.com> | ' || p.url || ' | ' || b.text), '[a-z0-9]+') AS ws FROM body b JOIN pages p USING (page_id)),
    places AS (SELECT page_id, list_transform(ws, lambda w: ('0x' || md5(w)[:8])::UBIGINT % 384) AS ps FROM said),
    counted AS (SELECT page_id, list_transform(range(384), lambda b: len(list_filter(ps, lambda x: x = b))::DOUBLE) AS c FROM places),
    embeddings AS (SELECT page_id AS vec_id, list_transform(c, lambda x: (x / sqrt(list_dot_product(c, c)))::FLOAT) AS embedding, page_id % 10 AS label FROM counted)"""


@query(f"WITH {_TEXT_VECTORS}, {_vectors_sql()} SELECT query_id, label, round(confidence, 4) AS confidence, action FROM acted")
def process_history_text(spark, sf_dir):
    """From raw pages to verdicts: body normalised, one text a message, vectors by the hashing embedder, neighbours, vote."""
    p = table(spark, sf_dir, "pages")
    messages = p.select(F.col("page_id").alias("message_id"), F.lit("page").alias("from_name"), F.concat(F.col("page_id").cast("string"), F.lit("@example.com")).alias("from_address"), F.col("url").alias("subject"), F.col("html").alias("body_html"), F.lit("").alias("list_id"))
    # Written once: the index, the queries and the labels' counts read them.
    live.message_vectors(messages, HashingEmbedder())(messages).write.parquet(path := new_folder(spark, "vectors"))
    vectors = spark.read.schema("message_id bigint, vector array<float>").parquet(path)
    label = F.when(F.col("message_id") % 10 == 9, SKIP).otherwise(F.concat(F.lit("L"), (F.col("message_id") % 10).cast("string")))
    index = vectors.select(F.col("message_id").alias("id"), "vector", label.alias("label"))
    q = views.queries(index)
    return vote.classify(q, index, knn.neighbours_blocked(q, index, exclude_self=True)).select("query_id", "label", F.round("confidence", 4).alias("confidence"), "action")


@query(f"""WITH {_STATE} SELECT message_id, 'INBOX' AS add_label, '{SKIP}' AS label_id FROM lab WHERE label_name = 'clean'""")
def reconcile_to_outbox(spark, sf_dir):
    """'clean' is deleted in the mailbox: its messages are rejects from now on, and the outbox puts them into the inbox."""
    store = _store(spark)
    store.commit({"labels": views.state_labels(spark, sf_dir).withColumn("message_id", F.col("message_id").cast("string"))})
    live.back_in_inbox(store, values(spark, [("T0", "clean", None, "deleted")], "label_id string, old_name string, new_name string, change string"))
    rows = store.table("outbox").join(store.table("labels").select("message_id", "label_id"), "message_id")
    return rows.select(F.col("message_id").cast("bigint").alias("message_id"), "add_label", "label_id")


# ---- progressive build -----------------------------------------------------------------------------------------------

_FOLDED = f"""{_WORK}, f AS (SELECT pos, message_id % 1000 AS message_id, label_id, label_name, source FROM planned),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY pos) AS nth FROM f)"""


def _folded(spark, sf_dir):
    """The work list with ids folded, so that messages stand in several buckets; every third has a vector already."""
    have = spark.range(0, 1000, 3).select(F.col("id").cast("string").alias("message_id"), F.array(F.lit(0.0).cast("float")).alias("vector"))
    return _planned(spark, sf_dir).withColumn("message_id", (F.col("message_id") % 1000).cast("string")), have


@query(f"""WITH {_FOLDED}, t AS (SELECT pos, CASE WHEN nth = 1 AND message_id % 3 <> 0 THEN 1 ELSE 0 END AS cost FROM firsts), s AS (SELECT *, sum(cost) OVER (ORDER BY pos) AS total FROM t),
    b AS (SELECT greatest(total - 1, 0) // 25 AS batch, count(*) AS n_rows, sum(cost) AS to_embed, max(pos) AS last_pos FROM s GROUP BY 1),
    lags AS (SELECT *, (last_pos + 1) // 100 * 100 AS now_at, coalesce(lag(last_pos + 1) OVER (ORDER BY batch), 0) // 100 * 100 AS was, lead(batch) OVER (ORDER BY batch) AS more FROM b)
    SELECT batch::BIGINT AS batch, n_rows, to_embed::BIGINT AS to_embed, last_pos, CASE WHEN more IS NOT NULL AND now_at > was THEN now_at END AS progress FROM lags""")
def progressive_batches(spark, sf_dir):
    """The work list in batches of at most 25 new vectors, with the positions that are reported."""
    planned, have = _folded(spark, sf_dir)
    work = new_folder(spark, "work")
    # Written, as both are read several times.
    planned.write.parquet(f"{work}/planned")
    admitted(spark.read.schema(planned.schema).parquet(f"{work}/planned"), have).write.parquet(f"{work}/admitted")
    return batches(spark.read.schema("pos bigint, cost int, batch bigint").parquet(f"{work}/admitted"))


@query(f"""WITH {_FOLDED} SELECT message_id, label_id, label_name, source, message_id AS total FROM firsts WHERE nth = 1 AND message_id % 3 <> 0 AND message_id % 11 <> 0""")
def progressive_build(spark, sf_dir):
    """The build in batches of at most 200 new vectors, by a new process after every other batch; every eleventh message no
    longer exists."""
    planned, have = _folded(spark, sf_dir)
    planned.write.parquet(path := new_folder(spark, "work"))
    planned = spark.read.schema(planned.schema).parquet(path)
    store = _store(spark)
    store.commit({"embeddings": have})
    embed = lambda ids: ids.where("message_id % 11 <> 0").select("message_id", F.array(F.col("message_id").cast("float")).alias("vector"))
    while True:
        build = ProgressiveBuild(store, embed, 200)
        build.plan(lambda: planned)
        build.run_for(0)
        build.run_batch()
        if build.finalise("a", "f", "h"):
            break
    made = store.table("embeddings").select("message_id", F.col("vector")[0].cast("bigint").alias("total"))
    return store.table("labels").join(made, "message_id").withColumn("message_id", F.col("message_id").cast("bigint"))


# ---- late rows -------------------------------------------------------------------------------------------------------

_LATE = """hours AS (SELECT date_trunc('hour', arrived_at) AS hour, max(ts) AS newest FROM clicks WHERE ts IS NOT NULL AND arrived_at IS NOT NULL GROUP BY 1),
    marks AS (SELECT hour, max(newest) OVER (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM hours),
    routed AS (SELECT c.*, CASE WHEN ts IS NULL OR arrived_at IS NULL THEN 'undated' WHEN ts < mark THEN 'late' ELSE 'on_time' END AS route FROM clicks c LEFT JOIN marks ON hour = date_trunc('hour', arrived_at))"""


def _split(spark, sf_dir):
    """clicks as a log that grows by a month at a time; the stream is started anew for each."""
    from labelflow.streaming.late import LateSplit

    work, clicks = new_folder(spark, "streams"), table(spark, sf_dir, "clicks").select("click_id", "ts", "arrived_at")
    split = LateSplit(spark, work, "ts", "arrived_at")
    month = F.coalesce(F.month("arrived_at"), F.lit(0))
    for k in [r[0] for r in clicks.select(month.alias("m")).distinct().sort("m").collect()]:
        clicks.where(month == k).write.mode("append").parquet(f"{work}/log")
        split.run(f"{work}/log", clicks.schema)
    return split.rows()


@query(f"WITH {_LATE} SELECT click_id, route FROM routed")
def late_side_output(spark, sf_dir):
    """On-time, late and undated rows of a stream: together all rows."""
    return _split(spark, sf_dir).select("click_id", "route")


@query(f"""WITH {_LATE} SELECT click_id AS message_id, 'late' AS reason FROM routed WHERE route = 'late' AND click_id IS NOT NULL AND epoch_us(ts) // 1000000 > 1705000000 AND click_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1""")
def late_parked(spark, sf_dir):
    """Messages of late rows that are not known: parked in the store."""
    from labelflow.streaming.late import park_late

    store = _store(spark)
    store.commit({"labels": views.state_labels(spark, sf_dir).withColumn("message_id", F.col("message_id").cast("string"))})
    late = _split(spark, sf_dir).where("route = 'late'").select(F.col("click_id").alias("message_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sent_s"))
    park_late(store, late, 1_705_000_000_000, "0")
    return store.table("pending_new").select(F.col("message_id").cast("bigint").alias("message_id"), "reason")


# ---- paged listings --------------------------------------------------------------------------------------------------


@query("SELECT event_id AS seq, event_type AS type, user_id AS message_id FROM events")
def paged_history(spark, sf_dir):
    """events as a paged change log, read page by page as a stream whose offset is the page token, in two runs."""
    root, work = new_folder(spark, "listing"), new_folder(spark, "streams")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("user_id").alias("message_id"))
    stage(e, "seq", root)
    spark.dataSource.register(PagedSource)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    for _ in range(2):
        q = spark.readStream.format("paged_listing").option("root", root).load().writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.schema("seq bigint, type string, message_id bigint, batch bigint").parquet(f"{work}/out").drop("batch")


# ---- streams: the same rows as their batch twins -----------------------------------------------------------------


@query(_NEW)
def stream_new_inbox(spark, sf_dir):
    from labelflow.streaming.pipeline import replay_new_inbox

    return replay_new_inbox(spark, views.history(spark, sf_dir), views.state_labels(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT message_id, arg_max(label_id, seq) AS label_id, max(seq) AS seq FROM ch WHERE type = 'labelsAdded' GROUP BY 1")
def stream_label_state(spark, sf_dir):
    from labelflow.streaming.pipeline import replay_label_state

    return replay_label_state(spark, views.history(spark, sf_dir), views.registry(spark))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: classify every query message from its neighbours."""
    return classify_shifted(spark, sf_dir)
