"""Query understanding: intents, planned searches, templates and weighted variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.config import DEFAULTS, Settings
from inkwell.functions import rules as R
from inkwell.functions import text as T

QUOTED_TITLE = "[《“\"]([^》”\"]+)[》”\"]"
PUNCTUATION = "[《》“”\"'，。！？?、]"
VARIANT_LIMIT = 260


def quoted_title(query: Column) -> Column:
    return T.strip(F.regexp_extract(query, QUOTED_TITLE, 1))


def _or(first: Column, second: Column) -> Column:
    return F.when(first != "", first).otherwise(second)


def is_lookup(query: Column) -> Column:
    return T.contains_any(query, R.LOOKUP_TERMS)


def is_memory_intent(query: Column) -> Column:
    return T.contains_any(query, R.MEMORY_INTENT_TERMS)


def is_concept_overview(query: Column) -> Column:
    return T.contains_any(query, R.CONCEPT_TERMS) & ~is_lookup(query)


def intent(query: Column, rules=R.INTENT_RULES) -> Column:
    """First matching class in rule order."""
    lowered = F.lower(query)
    tests = [
        (name, T.contains_any(query, terms) | T.contains_any(lowered, lower_terms)) for name, terms, lower_terms in rules
    ]
    return reduce(lambda chain, t: chain.when(t[1], F.lit(t[0])), tests, F).otherwise(F.lit(R.DEFAULT_INTENT))


def concept_query(query: Column) -> Column:
    """Search text for an overview question: polite openers and question words removed."""
    subject = T.strip(
        F.regexp_replace(_or(quoted_title(query), query), f"^(请|帮我|帮忙|麻烦)?{T.WS_CLASS}*", "")
    )
    bare = reduce(lambda s, term: F.replace(s, F.lit(term), F.lit(" ")), R.CONCEPT_TERMS, subject)
    named = F.btrim(T.compact_named(bare, 80), F.lit(" ，。！？?、"))
    return T.strip(F.concat(_or(named, query), F.lit(R.CONCEPT_SUFFIX)))


def planned_queries(query: Column, subject: Column, todo: Column, broaden: bool = False) -> Column:
    """The unrewritten search plan as an array of distinct texts."""
    focus = _or(quoted_title(query), T.compact_named(subject, 96))
    bare = T.compact_named(F.regexp_replace(query, PUNCTUATION, " "), 96)
    more = R.BROADEN_SUFFIXES if broaden else ()

    def with_suffixes(suffixes):
        wanted = list(dict.fromkeys([*suffixes, *more]))
        return F.array(query, focus, bare, *[F.concat(focus, F.lit(" " + s)) for s in wanted], todo)

    return T.distinct_texts(
        F.when(is_lookup(query), with_suffixes(R.LOOKUP_SUFFIXES)).otherwise(with_suffixes(R.GENERAL_SUFFIXES))
    )


def standalone_query(query: Column, subject: Column) -> Column:
    """Resolve pronouns and very short questions with the subject."""
    focus = _or(quoted_title(query), T.compact_named(subject, 120))
    bare = T.compact_named(F.regexp_replace(query, PUNCTUATION, " "), 160)
    absent = (focus != "") & ~F.contains(bare, focus)
    vague = T.contains_any(query, R.PRONOUN_TERMS) | (F.length(bare) < 18)
    return F.when(vague & absent, T.compact_named(F.concat_ws(" ", focus, bare), 180)).otherwise(_or(bare, query))


def expansion_terms(text: Column, intent_col: Column, rules=R.EXPANSIONS) -> Column:
    """Domain terms of all matching rules in rule order, distinct; empty when the gate is closed."""
    lowered = F.lower(text)
    gate = T.contains_any(text, R.EXPANSION_GATE_TEXT) | T.contains_any(lowered, R.EXPANSION_GATE_LOWER)

    def condition(rule: R.Expansion) -> Column:
        hit = F.lit(rule.always) | T.contains_any(text, rule.text) | T.contains_any(lowered, rule.lower)
        if rule.lower_unless:
            term, veto = rule.lower_unless
            hit = hit | (F.contains(lowered, F.lit(term)) & ~F.contains(lowered, F.lit(veto)))
        if rule.intent:
            hit = hit & (intent_col == rule.intent)
        if rule.not_intent:
            hit = hit & (intent_col != rule.not_intent)
        return hit

    chosen = F.flatten(F.array(*[F.when(condition(r), T.lits(r.terms)).otherwise(T.no_strings()) for r in rules]))
    return F.when(gate, T.distinct_texts(chosen)).otherwise(T.no_strings())


def template_focus(query: Column, subject: Column) -> Column:
    return _or(quoted_title(query), T.compact_named(subject, 100))


def step_back_query(focus: Column, intent_col: Column) -> Column:
    tail = reduce(lambda c, kv: c.when(intent_col == kv[0], F.lit(kv[1])), R.STEP_BACK.items(), F).otherwise(
        F.lit(R.STEP_BACK_DEFAULT)
    )
    return T.compact_named(F.concat(focus, tail), R.STEP_BACK_LIMIT)


def hyde_query(query: Column, subject: Column, focus: Column, intent_col: Column, expansions: Column) -> Column:
    added = F.array_join(F.slice(expansions, 1, R.HYDE_EXPANSIONS), " ")
    lowered = F.lower(F.concat_ws(" ", query, subject))
    noise = T.contains_any(lowered, R.HYDE_NOISE_LOWER) | T.contains_any(query, R.HYDE_NOISE_TEXT)

    def text(tail: str, limit: int, with_terms: bool) -> Column:
        parts = [focus, F.lit(tail)] + ([added] if with_terms else [])
        return T.compact_named(F.concat(*parts), limit)

    chain = F.when((intent_col == "robustness") & noise, text(*R.HYDE_NOISE, False))
    for name, template in R.HYDE.items():
        chain = chain.when(intent_col == name, text(*template))
    return chain.otherwise(text(*R.HYDE_DEFAULT))


def lexical_query(query: Column, subject: Column, expansions: Column) -> Column:
    tokens = T.tokenize(F.concat_ws(" ", subject, query))
    keywords = T.distinct_texts(F.concat(tokens, expansions))
    return T.compact_named(F.array_join(F.slice(keywords, 1, R.LEXICAL_TERMS), " "), 220)


def _variant(strategy: str, query: Column) -> Column:
    weight, rationale = R.VARIANTS[strategy]
    return F.struct(
        F.lit(strategy).alias("strategy"),
        T.compact_named(query, VARIANT_LIMIT).alias("query"),
        F.lit(weight).alias("weight"),
        F.lit(rationale).alias("rationale"),
    )


def rewrite_queries(queries: DataFrame, settings: Settings = DEFAULTS, broaden: bool = False) -> DataFrame:
    """Weighted variants of ``queries(query_id, query[, subject, todo_description])``.

    Returns ``query_id, query_no, strategy, query, weight, rationale, intent,
    original_query, standalone_query``; ``query_no`` is the search order.
    """
    if "subject" not in queries.columns:
        queries = queries.withColumn("subject", F.col("query"))
    if "todo_description" not in queries.columns:
        queries = queries.withColumn("todo_description", F.lit(""))
    q, subject = F.col("query"), F.col("subject")
    planned = planned_queries(q, subject, F.col("todo_description"), broaden)
    limit = max(settings.max_query_variants, 1)
    base = queries.select(
        "query_id", "query", "subject", planned.alias("planned"), intent(q).alias("intent")
    )
    if not settings.rewrite_enabled:
        plain = F.transform(
            F.slice("planned", 1, settings.max_query_variants),
            lambda p: F.struct(
                F.lit("baseline").alias("strategy"),
                p.alias("query"),
                F.lit(R.VARIANTS["baseline"][0]).alias("weight"),
                F.lit(R.VARIANTS["baseline"][1]).alias("rationale"),
            ),
        )
        rows = base.select(
            "query_id",
            F.lit("baseline").alias("intent"),
            q.alias("original_query"),
            q.alias("standalone_query"),
            F.posexplode_outer(plain).alias("at", "v"),
        )
    else:
        staged = base.select(
            "*",
            standalone_query(q, subject).alias("standalone"),
            template_focus(q, subject).alias("focus"),
            expansion_terms(F.concat_ws(" ", q, subject), F.col("intent")).alias("terms"),
        )
        parts = [
            F.transform("planned", lambda p: _variant("baseline_expansion", p)),
            F.array(_variant("standalone", F.col("standalone"))),
        ]
        if settings.step_back_enabled:
            parts.append(F.array(_variant("step_back", step_back_query(F.col("focus"), F.col("intent")))))
        parts.append(F.array(_variant("lexical_domain_expansion", lexical_query(q, subject, F.col("terms")))))
        if settings.hyde_enabled:
            hyde = hyde_query(q, subject, F.col("focus"), F.col("intent"), F.col("terms"))
            parts.append(
                F.when(
                    ~F.col("intent").isin(*R.HYDE_SKIPPED_INTENTS), F.array(_variant("hyde", hyde))
                ).otherwise(F.slice(F.array(_variant("hyde", F.lit(""))), 1, 0))
            )
        staged = staged.select("*", F.concat(*parts).alias("all"))
        keyed = staged.select("*", F.transform("all", lambda v: F.lower(v["query"])).alias("keys"))
        fresh = F.filter("all", lambda v, i: F.array_position(F.col("keys"), F.lower(v["query"])) == i + 1)
        ordered = F.array_sort(
            F.transform(fresh, lambda v, i: F.struct((-v["weight"]).alias("order"), i.alias("at"), v.alias("v")))
        )
        rows = keyed.select(
            "query_id",
            "intent",
            q.alias("original_query"),
            F.col("standalone").alias("standalone_query"),
            F.posexplode_outer(F.transform(F.slice(ordered, 1, limit), lambda o: o["v"])).alias("at", "v"),
        )
    return rows.select(
        "query_id",
        (F.col("at") + 1).alias("query_no"),
        "v.strategy",
        "v.query",
        "v.weight",
        "v.rationale",
        "intent",
        "original_query",
        "standalone_query",
    )


# --- memory focus -------------------------------------------------------------


def memory_terms(query: Column, limit: int = 24) -> Column:
    """Search terms for memory lines: tokens, cleaned pieces and short CJK n-grams."""

    def cleaned(piece):
        return reduce(lambda s, term: F.replace(s, F.lit(term), F.lit("")), R.CONCEPT_TERMS, piece)

    def grams(piece, size):
        return F.when(
            F.length(piece) >= size,
            F.transform(F.sequence(F.lit(1), F.length(piece) - size + 1), lambda i: piece.substr(i, F.lit(size))),
        ).otherwise(T.no_strings())

    def with_grams(piece):
        alone = F.array(piece)
        return F.when(
            piece.rlike(f"^{T.CJK_RUN}$"), F.concat(alone, grams(piece, 2), grams(piece, 3), grams(piece, 4))
        ).otherwise(alone)

    pieces = F.filter(
        F.transform(
            F.regexp_extract_all(query, F.lit("[一-鿿]{2,}|[A-Za-z0-9_./+-]{2,}"), F.lit(0)), cleaned
        ),
        lambda p: p != "",
    )
    raw = F.concat(T.tokenize(query), T.tokenize(concept_query(query)), F.flatten(F.transform(pieces, with_grams)))
    kept = F.filter(
        F.transform(raw, lambda t: F.lower(T.strip(t))),
        lambda t: (F.length(t) >= 2) & ~t.isin(*R.MEMORY_STOP_TERMS),
    )
    return F.slice(F.array_distinct(kept), 1, limit)


def memory_line_score(terms: Column, line: Column) -> Column:
    """One point per term found in the line, 0.7 for a term that is only a token of it."""
    lowered, tokens = F.lower(line), T.tokenize(line)
    return F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, t: acc
        + F.when(F.contains(lowered, t), F.lit(1.0)).when(F.array_contains(tokens, t), F.lit(0.7)).otherwise(F.lit(0.0)),
    )


def preference_hints(query: Column) -> Column:
    return F.filter(T.lits(R.PREFERENCE_TERMS), lambda t: F.contains(query, t))
