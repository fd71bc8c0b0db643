"""Hybrid search over facts, episodes and entities, and what comes along with its hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import INPUT_INVALID, RecordError
from palimpsest.functions.text import collapsed, idf, query_tokens, query_trigrams, sparse_score, strip, terms, text_or_empty, trigram_product, trigram_square
from palimpsest.memory import Memory
from palimpsest.operators.paging import ordered_page
from palimpsest.operators.scope import anchored, entities_for, episodes_for, fact_anchored, facts_for, scoped_episodes
from palimpsest.operators.temporal import entity_versions, visible_episodes, visible_sources
from palimpsest.plans.requests import SearchRequest, space_of
from palimpsest.sources import shared
from palimpsest.sources.shared import cut, light, sieve

# Fixed values of the ranking: bonuses by kind and match, the decay of a hop, the least trigram cosine.
BONUS = {"fact": 0.4, "episode": 0.2, "entity": 0.0}
ANCHOR_BONUS, PREDICATE_BONUS, DECAY, LEAST_COSINE = 0.15, 0.1, 0.45, 0.25
#: For each mode: score and reason of a substring; base, weight and reason of tokens; the same of trigrams.
LADDER = {
    "keyword": ((1.0, "keyword_match"), None, None),
    "hybrid": ((1.0, "hybrid_keyword_match"), (0.35, 0.45, "hybrid_token_overlap"), (0.25, 0.35, "hybrid_vector_similarity")),
    "semantic": ((0.9, "semantic_fallback"), (0.5, 0.5, "semantic_token_overlap"), (0.35, 0.4, "semantic_vector_similarity")),
}
TYPE_RANK = {"fact": 0, "episode": 1, "entity": 2}
HIT = ["hit_type", "record_id", "score", "matched_text", "reasons"]


def fact_text() -> Column:
    return F.concat(text_or_empty("value_text"), F.lit(" "), text_or_empty("predicate"), F.lit(" "), text_or_empty("subject_id"), F.lit(" "), text_or_empty("object_id"))


def entity_text() -> Column:
    return F.concat(text_or_empty("canonical_name"), F.lit(" "), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))


def candidates(memory: Memory, request: SearchRequest) -> DataFrame:
    """What the filters leave: (hit_type, record_id, text, matched_text, keys), keys being the ids that a hit leads to."""
    parts = []
    kinds = request.kinds if not request.predicates else tuple(k for k in request.kinds if k == "fact")
    ids = lambda *cols: F.array_compact(F.array(*(F.nullif(c, F.lit("")) for c in cols)))
    one = lambda df, kind, text, shown, keys: df.select(F.lit(kind).alias("hit_type"), F.col("id").alias("record_id"), text.alias("text"), shown.alias("matched_text"), keys.alias("keys"))
    if "fact" in kinds:
        facts = expandable(memory, request).where(fact_anchored(request.anchor_ids))
        keys = F.concat(ids("id", "subject_id", "object_id"), F.coalesce("supporting_episode_ids", F.array().cast("array<string>")))
        parts.append(one(facts, "fact", fact_text(), text_or_empty("value_text"), keys))
    if "episode" in kinds:
        episodes = episodes_for(memory, request.space_id, request.scope, request.temporal).where(anchored(request.anchor_ids, F.col("id"), F.col("source_id")))
        parts.append(one(episodes, "episode", text_or_empty("content"), text_or_empty("content"), ids("id", "source_id")))
    if "entity" in kinds:
        entities = entities_for(memory, request.space_id, request.scope, request.temporal).where(anchored(request.anchor_ids, F.col("id")))
        entities = entities.where(strip(text_or_empty("duplicate_of")) == "")
        parts.append(one(entities, "entity", entity_text(), text_or_empty("canonical_name"), ids("id")))
    if not parts:
        return memory.spark.createDataFrame([], "hit_type string, record_id string, text string, matched_text string, keys array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expandable(memory: Memory, request: SearchRequest) -> DataFrame:
    """Facts that expansion may reach: as direct hits, but whatever the anchors."""
    only = F.col("predicate").isin(*request.predicates) if request.predicates else F.lit(True)
    return facts_for(memory, request.space_id, request.scope, request.temporal, only)


def corpus_stats(found: DataFrame, query: list[str]) -> tuple[int, dict[str, int]]:
    """Documents with a token at all, and those with each of the query's: one row, whatever the corpus."""
    own = found.select(terms(F.col("text")).alias("own"))
    row = own.agg(F.count_if(F.size("own") > 0), *(F.count_if(F.array_contains("own", t)) for t in query)).first()
    return row[0], dict(zip(query, row[1:], strict=True))


def scored(found: DataFrame, query: str, mode: str) -> DataFrame:
    """`base` and `reason` of the candidates that match; columns as given. One pass, nothing is shuffled.

    A text is tested for the substring, then for tokens, then for trigrams. A cosine of LEAST_COSINE
    needs a product of at least that times the lengths, and a text's length is at least the root of
    its number of trigrams, so most texts are refused before their own trigrams are counted.
    """
    (hit, hit_reason), by_tokens, by_grams = LADDER.get(mode, LADDER["hybrid"])
    inside = F.contains("_low", F.lit(query))
    direct = _bound(found, "_low", strip(F.lower("text"))).where("_low <> ''")
    if by_tokens is None:
        return direct.where(inside).select(*found.columns, F.lit(hit).alias("base"), F.lit(hit_reason).alias("reason"))
    wanted, grams = query_tokens(query), query_trigrams(query)
    n, df = corpus_stats(found, wanted)
    weights = {t: idf(n, df[t]) for t in wanted} if n else {}
    own = _bound(direct, "_terms", F.when(~inside, terms(F.col("_low"))))
    own = _bound(own, "_sparse", F.when(inside, 0.0).otherwise(sparse_score(F.col("_terms"), wanted, weights))).drop("_terms")
    rest = ~inside & (F.col("_sparse") <= 0)
    if grams:
        norm = sum(c * c for c in grams.values()) ** 0.5
        own = _bound(own, "_flat", F.when(rest, collapsed(F.col("_low"))))
        own = _bound(own, "_dot", F.when(rest, trigram_product(F.col("_flat"), grams)))
        likely = (F.col("_dot") > 0) & (F.col("_dot") >= F.lit(LEAST_COSINE * norm * (1 - 1e-9)) * F.sqrt(F.greatest(F.length("_flat") - 2, F.lit(0))))
        own = _bound(own.where(~rest | likely), "_cosine", F.when(rest, F.col("_dot") / (F.lit(norm) * F.sqrt(trigram_square(F.col("_flat")).cast("double")))))
        own = own.where(~rest | (F.col("_cosine") >= LEAST_COSINE))
    else:
        own = own.where(~rest).withColumn("_cosine", F.lit(0.0))
    sparse = F.col("_sparse") > 0
    base = F.when(inside, hit).when(sparse, F.col("_sparse") * by_tokens[1] + by_tokens[0]).otherwise(F.col("_cosine") * by_grams[1] + by_grams[0])
    reason = F.when(inside, hit_reason).when(sparse, by_tokens[2]).otherwise(by_grams[2])
    return own.select(*found.columns, base.alias("base"), reason.alias("reason"))


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once a row: as a generator's output, conditions on it do not repeat its expression further down."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def direct_hits(memory: Memory, request: SearchRequest, within: DataFrame | None = None) -> DataFrame:
    """Hits of the text itself, with their keys; of the records of `within` (hit_type, record_id) only, where it is given."""
    query = request.query_text.strip().lower()
    if not query:
        raise RecordError(INPUT_INVALID, "query_text is required", field="query_text")
    found = candidates(memory, request)
    if within is not None:
        found = found.join(within, ["hit_type", "record_id"], "left_semi")
    return weighed(found, request)


def weighed(found: DataFrame, request: SearchRequest) -> DataFrame:
    """Hits among candidates at hand."""
    found = scored(found, request.query_text.strip().lower(), request.mode)
    fact, score = F.col("hit_type") == "fact", F.col("base")
    bonus = F.when(fact, BONUS["fact"]).when(F.col("hit_type") == "episode", BONUS["episode"]).otherwise(BONUS["entity"])
    score, reasons = score + bonus, [F.col("reason")]
    if request.anchor_ids:
        score = score + ANCHOR_BONUS
        reasons.append(F.lit("anchor_match"))
    if request.predicates:
        score = score + F.when(fact, PREDICATE_BONUS).otherwise(0.0)
        reasons.append(F.when(fact, "predicate_filter"))
    out = found.select("hit_type", "record_id", score.alias("score"), "matched_text", F.array_compact(F.array(*reasons)).alias("reasons"), "keys")
    return out if request.min_score is None else out.where(F.col("score") >= request.min_score)


#: What a hop reads of a fact, and how many of its supporting episodes are tested where it lies.
ENDS = ["id", "subject_id", "object_id", "value_text", "supporting_episode_ids"]
TESTED = 2


def _once(ids: Column) -> Column:
    """Each id once, without nulls: one compiled call, unlike array_compact."""
    return F.array_except(ids, F.array(F.lit(None).cast("string")))


def _ends() -> Column:
    """A fact's ids that a seed may lead to."""
    return _once(F.concat(F.array("subject_id", "object_id"), F.coalesce("supporting_episode_ids", F.array().cast("array<string>"))))


def _leads() -> Column:
    """The ids that a fact leads to."""
    return F.concat(F.array_compact(F.array("id", "subject_id", F.nullif("object_id", F.lit("")))), F.coalesce("supporting_episode_ids", F.array().cast("array<string>")))


def _best(seeds: DataFrame) -> DataFrame:
    """For each id of (key, score) the best score, from a checkpoint."""
    return cut(seeds.where("key <> ''").groupBy("key").agg(F.max("score").alias("score")))


def _hop(rest: DataFrame, best: DataFrame, min_score: float | None) -> tuple[DataFrame, DataFrame]:
    """Facts that may have an end among the best seeds, with the decayed score (none, if they have not), and those that have none for sure.

    A sieve tells where the facts lie which ends are likely a seed's. A fact without one is not moved,
    one with a single one goes to its seed once and whole; the scores of several ends come together by its id.
    """
    n = best.count()
    hit = sieve(best, "key", n)
    seeds = light(best, n) if n <= shared.LIGHT else best.hint("shuffle_hash")
    tested = [F.col("subject_id"), F.col("object_id"), *(F.get("supporting_episode_ids", F.lit(i)) for i in range(TESTED))]
    rest = _bound(rest, "_near", _once(F.array(*(F.when(hit(F.xxhash64(c)), c) for c in tested))))
    many, n = F.coalesce(F.size("supporting_episode_ids"), F.lit(0)) > TESTED, F.size("_near")
    far, one, several = rest.where(~many & (n == 0)).select(*ENDS), rest.where(~many & (n == 1)), rest.where(many | (n > 1))
    score = F.col("score") * DECAY
    kept = score > 0 if min_score is None else (score > 0) & (score >= min_score)
    decayed = F.when(kept, score).alias("score")
    single = one.withColumn("key", F.get("_near", F.lit(0))).join(seeds, "key", "left").select(*ENDS, decayed)
    scores = several.select("id", F.explode(_ends()).alias("key")).where(hit(F.xxhash64("key"))).join(seeds, "key").groupBy("id").agg(F.max("score").alias("score"))
    return single.unionByName(several.join(scores, "id", "left").select(*ENDS, decayed)), far


def _as_hits(facts: DataFrame, reason: str) -> DataFrame:
    return facts.select(F.lit("fact").alias("hit_type"), F.col("id").alias("record_id"), "score", text_or_empty("value_text").alias("matched_text"), F.array(F.lit(reason)).alias("reasons"), _leads().alias("keys"))


def all_hits(memory: Memory, request: SearchRequest) -> DataFrame:
    """Direct hits and, unless the mode is keyword, two hops of facts around them."""
    hits = direct_hits(memory, request)
    if request.mode == "keyword" or "fact" not in request.kinds:
        return hits
    hits = cut(hits)  # each hop needs them
    seen = hits.where("hit_type = 'fact'").select(F.col("record_id").alias("id"))
    n = seen.count()
    rest = expandable(memory, request).select(*ENDS).join(light(seen, n), "id", "left_anti")
    if n > shared.LIGHT or request.temporal.as_of or request.scope.entity_types or request.scope.by_episode:
        rest = cut(rest)  # else no more than a filter of the stored facts, which are read again
    near, far = _hop(rest, _best(hits.select(F.explode("keys").alias("key"), "score")), request.min_score)
    near = cut(near)
    first, left = near.where("score IS NOT NULL"), far.unionByName(near.where("score IS NULL").drop("score"))
    out = hits.unionByName(_as_hits(first, "graph_expansion"))
    reached, others = first.count(), left.count()
    if not reached or not others:
        return out
    seeds = first.select(F.explode(_leads()).alias("key"), "score")
    if others <= reached:  # only seeds at an end of what is left
        left = cut(left)
        ends = left.select(F.explode(_ends()).alias("key"))
        seeds = seeds.where(sieve(ends, "key", ends.count())(F.xxhash64("key")))
    second, _ = _hop(left, _best(seeds), request.min_score)
    return out.unionByName(_as_hits(second.where("score IS NOT NULL"), "graph_expansion_bfs"))


def hit_order() -> list[Column]:
    rank = F.when(F.col("hit_type") == "fact", TYPE_RANK["fact"]).when(F.col("hit_type") == "episode", TYPE_RANK["episode"]).otherwise(TYPE_RANK["entity"])
    return [F.col("score").desc(), F.col("record_id").asc(), rank.asc()]


def search(memory: Memory, request: SearchRequest) -> DataFrame:
    """One page of hits: by score, then record id."""
    return named_hits(ordered_page(all_hits(memory, request), hit_order(), request.page))


def named_hits(page: DataFrame) -> DataFrame:
    return page.select(F.concat(F.lit("hit_"), "record_id").alias("hit_id"), *HIT)


@dataclass(frozen=True)
class Included:
    facts: DataFrame
    episodes: DataFrame
    entities: DataFrame
    sources: DataFrame


def included(memory: Memory, request: SearchRequest, hits: DataFrame) -> Included:
    """Records that belong to all hits (not only to a page): the hits, and the support of its facts."""
    t, space = request.temporal, space_of(request.space_id)
    ids = lambda kind: hits.where(F.col("hit_type") == kind).select(F.col("record_id").alias("id"))
    return with_support(memory, request, expandable(memory, request).join(ids("fact"), "id", "left_semi"), ids("episode"), ids("entity"), t, space)


def with_support(memory: Memory, request, facts: DataFrame, episode_ids: DataFrame, entity_ids: DataFrame, t, space: str) -> Included:
    ends = facts.select(F.explode(F.array_compact(F.array("subject_id", "object_id"))).alias("id"))
    versions = entity_versions(memory, t)
    typed = versions.where(F.col("type").isin(*request.scope.entity_types)) if request.scope.entity_types else versions
    entities = typed.join(ends.unionByName(entity_ids).distinct(), "id", "left_semi")
    held = facts.select(F.explode("supporting_episode_ids").alias("id"), "space_id").distinct()
    allowed = scoped_episodes(memory, visible_episodes(memory, t), request.scope)
    episodes = allowed.join(held, ["id", "space_id"], "left_semi").unionByName(allowed.join(episode_ids, "id", "left_semi").select(allowed.columns)).dropDuplicates(["id"])
    own = episodes.select(F.col("source_id").alias("id"), "space_id").distinct()
    sources = visible_sources(memory, t).where(F.col("space_id") == space).join(own, ["id", "space_id"], "left_semi")
    order = lambda df, like: df.select(like.columns).orderBy("id")
    return Included(order(facts, memory.facts), order(episodes, memory.episodes), order(entities, memory.entities), order(sources, memory.sources))


def lookup_included(memory: Memory, request, facts: DataFrame) -> Included:
    """The same for the facts of a lookup."""
    none = memory.episodes.select("id").limit(0)
    return with_support(memory, request, facts, none, none, request.temporal, space_of(request.space_id))
