"""Corpus identity, near-duplicate questions, held-out contamination and trajectories over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import contamination as C
from inkwell.operators import identity as I
from inkwell.operators import similarity as S
from inkwell.operators import trajectories as TR
from inkwell.session import spread, table
from inkwell.workload.registry import register

# ------------------------------------------------------------------------------------------------ identity (K1)


def _reach(source: str) -> str:
    """CTEs from ``source(id, key)`` to ``labels(id, component)``: the least id over any number of shared keys."""
    return f"""
    bound AS (SELECT DISTINCT a.id AS u, b.id AS v FROM
      (SELECT id, key, min(id) OVER (PARTITION BY key) AS hub FROM {source}) a
      JOIN (SELECT DISTINCT key, min(id) OVER (PARTITION BY key) AS id FROM {source}) b ON a.hub = b.id AND a.key = b.key WHERE a.id <> b.id),
    ends AS (SELECT u, v FROM bound UNION SELECT v, u FROM bound),
    walk AS (SELECT u AS id, u AS seen FROM ends UNION SELECT w.id, b.v FROM walk w JOIN ends b ON b.u = w.seen),
    labels AS (SELECT id, min(seen) AS component FROM walk GROUP BY id)"""


_NORM = "nullif(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"
_FIRST = _NORM.format(x="split_part(text, chr(10), 1)")
_LAST = _NORM.format(x="split_part(text, chr(10), -1)")


@register(
    "corpus_identity",
    f"""WITH RECURSIVE k AS (
      SELECT doc_id AS id, unnest(['body:' || {_NORM.format(x='text')}, 'title:' || {_FIRST}, 'close:' || {_LAST}]) AS key FROM documents),
    keyed AS (SELECT DISTINCT id, key FROM k WHERE key IS NOT NULL), {_reach('keyed')}
    SELECT doc_id AS id, coalesce(component, doc_id) AS component, coalesce(component, doc_id) = doc_id AS kept
    FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN labels ON id = doc_id""",
)
def corpus_identity(spark, sf):
    """Documents are the same if their body, their first line or their last line agrees after normalisation."""
    docs = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    text = F.col("text")
    keys = [
        I.digest_key("body", I.normalised(text)),
        I.digest_key("title", I.normalised(F.split_part(text, F.lit("\n"), F.lit(1)))),
        I.digest_key("close", I.normalised(F.split_part(text, F.lit("\n"), F.lit(-1)))),
    ]
    return I.identity_classes(docs, "doc_id", keys)


_URL = "regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www[.])?', ''), '[?#].*$', ''), '/+$', '')"
_TITLE = _NORM.format(x="nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")


@register(
    "page_identity",
    f"""WITH RECURSIVE k AS (
      SELECT page_id AS id, unnest(['url:' || nullif({_URL}, ''), 'title:' || {_TITLE}, 'html:' || nullif(html, '')]) AS key FROM pages),
    keyed AS (SELECT DISTINCT id, key FROM k WHERE key IS NOT NULL), {_reach('keyed')}
    SELECT component, count(*) AS n_pages, max(page_id) AS last_page FROM
      (SELECT DISTINCT page_id, coalesce(component, page_id) AS component FROM pages LEFT JOIN labels ON id = page_id) GROUP BY component""",
)
def page_identity(spark, sf):
    """Pages are the same if canonical address, title or bytes agree; one row per class."""
    pages = spread(table(spark, sf, "pages"), "page_id").select("page_id", "url", "html")
    url = F.regexp_replace(F.lower("url"), r"^[a-z]+://(www[.])?", "")
    url = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"/+$", "")
    title = F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    keys = [
        I.digest_key("url", F.nullif(url, F.lit(""))),
        I.digest_key("title", I.normalised(title)),
        I.digest_key("html", F.nullif(F.col("html"), F.lit(""))),
    ]
    found = I.identity_classes(pages, "page_id", keys)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n_pages"), F.max("id").alias("last_page"))


# ------------------------------------------------------------------------------------------------ near-duplicate questions (K2)

THRESHOLD = 0.9

#: every vector, a disturbed copy of every third and an equal copy of every fifth: the smaller tables hold no near pairs of their own
QUESTION_SQL = """SELECT vec_id AS id, embedding AS vector FROM embeddings
    UNION ALL SELECT vec_id + 10000000, list_transform(embedding, lambda x, i: (x::DOUBLE * (1 + 0.25 * (((i - 1) * 7 + vec_id) % 5 - 2)))::FLOAT)
      FROM embeddings WHERE vec_id % 3 = 0
    UNION ALL SELECT vec_id + 20000000, list_transform(embedding, lambda x, i: (x::DOUBLE * (1 + 0.4 * (((i - 1) * 3 + vec_id) % 4 - 1.5)))::FLOAT)
      FROM embeddings WHERE vec_id % 4 = 0
    UNION ALL SELECT vec_id + 30000000, embedding FROM embeddings WHERE vec_id % 5 = 0"""


def question_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))

    def disturbed(every, shift, scale, step, width, middle):
        weight = lambda i: 1 + F.lit(scale) * (F.pmod(i * step + F.col("vec_id"), F.lit(width)) - F.lit(middle))
        moved = F.transform("vector", lambda x, i: (x.cast("double") * weight(i)).cast("float"))
        return vectors.where(F.col("vec_id") % every == 0).select((F.col("vec_id") + shift).alias("id"), moved.alias("vector"))

    return (
        vectors.withColumnRenamed("vec_id", "id")
        .unionByName(disturbed(3, 10_000_000, 0.25, 7, 5, 2.0))
        .unionByName(disturbed(4, 20_000_000, 0.4, 3, 4, 1.5))
        .unionByName(vectors.where("vec_id % 5 = 0").select((F.col("vec_id") + 30_000_000).alias("id"), "vector"))
    )


@register(
    "near_duplicate_questions",
    f"""WITH RECURSIVE q AS ({QUESTION_SQL}),
    c AS (SELECT vector, min(id) AS class_id, count(*) AS n_copies FROM q GROUP BY vector),
    links AS (SELECT a.class_id AS u, b.class_id AS v FROM c a JOIN c b ON a.class_id <> b.class_id
      WHERE round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), {S.DIGITS}) >= {THRESHOLD}),
    walk AS (SELECT u AS id, u AS seen FROM links UNION SELECT w.id, l.v FROM walk w JOIN links l ON l.u = w.seen),
    labels AS (SELECT id, min(seen) AS component FROM walk GROUP BY id),
    counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
    SELECT q.id, class_id, n_copies, coalesce(n_links, 0) AS n_links, coalesce(component, class_id) AS component
    FROM q JOIN c USING (vector) LEFT JOIN counts ON u = class_id LEFT JOIN labels l ON l.id = class_id""",
)
def near_duplicate_questions(spark, sf):
    return S.near_duplicates(question_vectors(spark, sf), THRESHOLD)


# ------------------------------------------------------------------------------------------------ contamination (K3)

_SHINGLES = """CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END"""
_CONTAMINATION = f"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    docs AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM words),
    item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
    items AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM item_words)"""


@register(
    "heldout_contamination",
    f"""WITH {_CONTAMINATION}
    SELECT doc_id AS id, count(*) AS n_shingles, count(*) FILTER (s IN (SELECT s FROM items)) AS n_hits,
           round(count(*) FILTER (s IN (SELECT s FROM items)) / count(*), 9) AS hit_share
    FROM docs GROUP BY doc_id HAVING n_hits > 0""",
)
def heldout_contamination(spark, sf):
    texts, _ = C.contamination(_corpus(spark, sf), _held(spark, sf))
    return texts.withColumn("hit_share", F.round("hit_share", 9))


@register(
    "heldout_exposure",
    f"""WITH {_CONTAMINATION}
    SELECT item_id AS item, count(*) AS n_shingles, count(*) FILTER (s IN (SELECT s FROM docs)) AS n_found,
           round(count(*) FILTER (s IN (SELECT s FROM docs)) / count(*), 9) AS found_share
    FROM items GROUP BY item_id""",
)
def heldout_exposure(spark, sf):
    _, exposed = C.contamination(_corpus(spark, sf), _held(spark, sf))
    return exposed.withColumn("found_share", F.round("found_share", 9))


def _corpus(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "text")


def _held(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


# ------------------------------------------------------------------------------------------------ trajectories (K4)

GAMMA = 0.9137
#: reward and potential of an event, as a user's run goes on
REWARDS = {"purchase": 1.0, "signup": 0.5, "error": -0.5}
STEP_COST = -0.01
POTENTIALS = {"signup": 0.1, "view": 0.2, "click": 0.4, "purchase": 1.0}


def _case(values: dict[str, float], other: float) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {other}::DOUBLE END"


def steps(spark, sf):
    of = lambda values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("event_type")), F.lit(other))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("trajectory"), "ts", "event_id", F.col("event_type").alias("state"), F.col("props").alias("action"),
        of(REWARDS, STEP_COST).alias("reward"), of(POTENTIALS, 0.0).alias("potential"),
    )


@register(
    "transitions",
    f"""WITH RECURSIVE s AS (
      SELECT user_id, ts, event_id, event_type, props, {_case(REWARDS, STEP_COST)} AS reward, {_case(POTENTIALS, 0.0)} AS potential FROM events),
    n AS (SELECT *, lead(event_type) OVER w AS next_state, lead(potential) OVER w AS next_potential,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT user_id, event_id, back, reward AS total FROM n WHERE back = 1
      UNION ALL SELECT n.user_id, n.event_id, n.back, n.reward + {GAMMA}::DOUBLE * g.total FROM g JOIN n ON n.user_id = g.user_id AND n.back = g.back + 1)
    SELECT n.user_id AS trajectory, n.event_id, n.event_type AS state, n.props AS action, n.reward, next_state, n.back = 1 AS done,
           round(n.reward + {GAMMA}::DOUBLE * coalesce(next_potential, 0) - potential, 7) AS shaped_reward, round(g.total, 7) AS discounted_return
    FROM n JOIN g USING (user_id, event_id)""",
)
def transitions(spark, sf):
    return TR.transitions(steps(spark, sf), ["ts", "event_id"], GAMMA).select(
        "trajectory", "event_id", "state", "action", "reward", "next_state", "done",
        F.round("shaped_reward", 7).alias("shaped_reward"), F.round("discounted_return", 7).alias("discounted_return"),
    )
