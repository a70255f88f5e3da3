"""Claim ↔ passage matching.

``concepts`` reads each claim and each passage once.  ``candidates`` finds the
pairs that can possibly matter with an inverted index instead of comparing every
claim with every passage, and loses none:

* a pair counts only when it shares the claim's head or enough topic terms;
* without the head, r of a claim's n topic terms must be shared, r being three and
  at least half of them (all of them when there are fewer than three); sharing r
  terms means sharing one of any n - r + 1, so a claim is looked up under its
  n - r + 1 rarest terms only;
* heads and configured phrases are looked up under keys of their own.

``match`` then runs the staged rules on the surviving pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import numerics, text
from probatio.operators import classify
from probatio.profiles import Profile
from probatio.session import cut_lineage, shuffled

_EDGE = "\u0002"  # marks word boundaries, so a whole-word test is a plain contains

CLAIM_KEYS = ["package_id", "claim_id"]
PASSAGE_KEYS = ["package_id", "source_ref", "passage_ord"]


def _mark_words(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\b", _EDGE)


def concepts(texts: DataFrame, column: str, profile: Profile,
             with_numerics: bool = True) -> DataFrame:
    """Add the structured view of a text column.

    topic_terms, generic_terms, phrases, head_phrase, numerics, category and, when
    the input has none, region (UNKNOWN unless the text names one).
    """
    generic = text.string_array(profile.generic_tokens)
    norm = F.col("norm")
    phrases = [F.when(text.has_term(norm, [p]), F.lit(p)) for p in profile.phrases]
    any_phrase = text.whole_word_pattern(profile.phrases)
    read = text.once(texts, norm=text.normalise(F.coalesce(F.col(column), F.lit(""))))
    read = text.once(
        read, _terms=text.token_set(norm, fv.MATCH_STOPWORDS),
        category=classify.category(F.col(column), norm, profile))
    read = text.once(
        read, topic_terms=F.array_sort(F.array_except("_terms", generic)),
        generic_terms=F.array_sort(F.array_intersect("_terms", generic))
    ).withColumn("numerics", numerics.quantities(F.col(column)) if with_numerics
                 else F.array().cast(numerics.NUMERIC_TYPE))
    if "region" not in texts.columns:
        read = text.once(read, region=classify.region(norm, profile))
    if any_phrase:
        # Longest-first alternation: the earliest phrase, the longest at a tie.
        found = F.regexp_extract(norm, any_phrase, 0)
        read = text.once(
            text.once(read, _phrase=F.when(
                text.contains_any(norm, profile.phrases) & (found != ""), found)),
            phrases=F.when(F.col("_phrase").isNull(), text.string_array([]))
            .otherwise(F.array_compact(F.array(*phrases))))
    else:
        read = read.withColumn("_phrase", F.lit(None).cast("string")).withColumn(
            "phrases", text.string_array([]))
    # Without a phrase: the first two words that are topic terms as they stand.  Set
    # intersection keeps the order of the words and hashes the terms.
    own = text.once(read, _words=F.when(F.col("_phrase").isNull(), F.split(norm, " ")))
    own = text.once(own, _first=F.get(
        F.array_intersect("_words", "topic_terms"), F.lit(0)))
    after = F.slice("_words", F.array_position("_words", F.col("_first")).cast("int") + 1,
                    F.size("_words"))
    second = F.get(F.array_intersect(after, "topic_terms"), F.lit(0))
    return own.withColumn("head_phrase", F.coalesce(
        "_phrase", F.when(F.col("_first").isNotNull(), F.concat_ws(" ", "_first", second)))
    ).drop("_terms", "_phrase", "_words", "_first")


def compatible_categories(claim: Column, passage: Column) -> Column:
    """Whether a passage of one category may bear on a claim of another."""
    pairs = [f"{c}>{p}" for c, ps in fv.COMPATIBLE_CATEGORIES.items() for p in ps]
    return (claim.isNull() | passage.isNull() | (claim == passage)
            | ~claim.isin(*fv.COMPATIBLE_CATEGORIES)
            | F.concat_ws(">", claim, passage).isin(*pairs))


def _scopes_meet(claim: Column, passage: Column, profile: Profile) -> Column:
    return ((claim == "UNKNOWN") | (passage == "UNKNOWN")
            | classify.covers(passage, claim, profile))


def _head_terms(claims: DataFrame) -> Column:
    """Stems of the words of an unconfigured head."""
    configured = F.array_contains("phrases", F.col("head_phrase"))
    return F.when(
        F.col("head_phrase").isNull() | configured, text.string_array([])
    ).otherwise(F.transform(F.split("head_phrase", " "), text.stem))


def _needed(n: Column) -> Column:
    """How many of a claim's n topic terms a passage without its head must share."""
    return F.least(n, F.greatest(
        F.lit(fv.MIN_TOPIC_OVERLAP), F.ceil(n * fv.MIN_TOPIC_COVERAGE).cast("int")))


def _claim_keys(claims: DataFrame, term_counts: DataFrame) -> DataFrame:
    """Lookup keys of each claim: rarest topic terms, head terms, phrases."""
    terms = claims.select(
        *CLAIM_KEYS, F.explode(F.col("topic_terms")).alias("term"))
    ranked = (
        terms.join(shuffled(term_counts), "term", "left")
        .groupBy(*CLAIM_KEYS)
        .agg(F.array_sort(F.collect_list(F.struct(
            F.coalesce("passages", F.lit(0)).alias("passages"), "term"))).alias("_r"))
    )  # a claim holds at most a few dozen terms, so this list is bounded
    n = F.size("_r")
    rare = ranked.select(
        *CLAIM_KEYS, F.explode(F.slice("_r", F.lit(1), n - _needed(n) + 1)).alias("r"),
    ).select(*CLAIM_KEYS, F.concat(F.lit("t:"), F.col("r.term")).alias("key"))
    named = F.concat(
        F.transform(_head_terms(claims), lambda t: F.concat(F.lit("t:"), t)),
        F.transform("phrases", lambda p: F.concat(F.lit("p:"), p)))
    return rare.unionByName(
        claims.select(*CLAIM_KEYS, F.explode(named).alias("key"))).distinct()


HOT_SHARE = 1_000
SMALL_PACKAGE = 2_500  # pairs
FEW_CLAIMS = 2_000_000  # characters of all claims together


def _passage_keys() -> Column:
    return F.concat(
        F.transform("topic_terms", lambda t: F.concat(F.lit("t:"), t)),
        F.transform("phrases", lambda p: F.concat(F.lit("p:"), p)))


def _postings(passages: DataFrame) -> DataFrame:
    """One row per passage and key, with what the join tests."""
    read = text.once(passages, _keys=_passage_keys())
    return text.once(read, _p_keys=_hashed("_keys")).select(
        *PASSAGE_KEYS, F.col("region").alias("_p_region"),
        F.col("category").alias("_p_category"), "_p_keys", F.explode("_keys").alias("key"))


def _hashed(keys: Column | str) -> Column:
    """Short hashes, since every posting carries them: equal ones only let pairs in."""
    return F.array_distinct(F.transform(keys, lambda k: F.hash(k)))


def _asked(claims: DataFrame) -> DataFrame:
    """What a passage must hold to matter to a claim, as hashes of keys: ``_c_least`` of
    ``_c_terms``, or all of ``_c_head``, or one of ``_c_phrases``.

    Of an unconfigured head only words that are their own stems are asked for, since other
    passages need not have theirs among the topic terms; without such a word any will do.
    Terms of equal hash count once, so fewer are asked for then.
    """
    def of(kind: str, values: Column | str) -> Column:
        return _hashed(F.transform(values, lambda v: F.concat(F.lit(kind), v)))

    configured = F.array_contains("phrases", F.col("head_phrase"))
    words = F.filter(F.split("head_phrase", " "), lambda w: text.stem(w) == w)
    n = F.size("topic_terms")
    read = text.once(
        claims, _c_terms=of("t:", "topic_terms"), _c_phrases=of("p:", "phrases"),
        _c_head=F.when(F.col("head_phrase").isNotNull() & ~configured, of("t:", words)))
    return read.select(
        *CLAIM_KEYS, "_c_terms", "_c_phrases", "_c_head",
        (_needed(n) - n + F.size("_c_terms")).alias("_c_least"))


def _may_matter() -> Column:
    """True for every pair that the rules do not refuse by head or terms, and few others."""
    shared = F.size(F.array_intersect("_c_terms", "_p_keys"))
    headed = F.size(F.array_except("_c_head", "_p_keys")) == 0
    return ((shared >= F.col("_c_least")) | (F.col("_c_head").isNotNull() & headed)
            | F.arrays_overlap("_c_phrases", "_p_keys"))


def hot_keys(counts: DataFrame) -> DataFrame:
    """Keys with more than a thousandth of all postings and into how many parts they go.

    ``counts``: package_id, key, passages.  There are fewer than a thousand of them, so
    the result may be broadcast whatever the size of the corpus.
    """
    total = counts.agg(F.coalesce(F.sum("passages"), F.lit(0))).scalar()
    share = F.col("passages") * HOT_SHARE / total
    return F.broadcast(counts.select(
        "package_id", "key", F.ceil(share).cast("int").alias("_parts")).where("_parts > 1"))


def candidates(claims: DataFrame, passages: DataFrame, profile: Profile,
               refused: bool = True) -> DataFrame:
    """Every (claim, passage) pair of a package that can support or disagree.

    Region and category refusals are applied inside the join.  Pairs grow with the square of
    a package; without ``refused`` those that share too little go there too, by the hashes
    that both sides carry (``_may_matter``), so that only what may matter is shuffled.  The postings of every key
    are counted first; a hot key (``hot_keys``) is spread over parts in proportion to its
    share, and only the claims that look such a key up are repeated, once per part.
    """
    postings = _postings(passages)
    if refused:
        postings = postings.drop("_p_keys")
    counts = cut_lineage(postings.groupBy("package_id", "key").agg(
        F.count("*").alias("passages")))
    hot = hot_keys(counts)
    term_counts = counts.where(F.col("key").startswith("t:")).groupBy(
        F.substring("key", 3, 1_000_000_000).alias("term")).agg(
        F.sum("passages").alias("passages"))
    parts = F.coalesce("_parts", F.lit(1))
    left = (
        _claim_keys(claims, term_counts)
        .join(shuffled(claims.select(
            *CLAIM_KEYS, F.col("region").alias("_c_region"),
            F.col("category").alias("_c_category"))), CLAIM_KEYS)
        .join(hot, ["package_id", "key"], "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    )
    right = postings.join(hot, ["package_id", "key"], "left").withColumn(
        "_salt", F.pmod(F.xxhash64("source_ref", "passage_ord"), parts).cast("int")).drop("_parts")
    fits = (_scopes_meet(F.col("_c_region"), F.col("_p_region"), profile)
            & compatible_categories(F.col("_c_category"), F.col("_p_category")))
    if not refused:
        left = left.join(shuffled(_asked(claims)), CLAIM_KEYS)
        fits = fits & _may_matter()
    return (
        left.join(shuffled(right), ["package_id", "key", "_salt"]).where(fits)
        .select("package_id", "claim_id", "source_ref", "passage_ord").distinct()
    )


def _side(frame: DataFrame, keys: list[str], prefix: str, names: list[str]) -> DataFrame:
    return frame.select(*keys, *[F.col(n).alias(prefix + n) for n in names])


def _claim_side(claims: DataFrame) -> DataFrame:
    return _side(
        claims.withColumn("head_marked", _mark_words(F.col("head_phrase")))
        .withColumn("head_terms", text.token_set(
            F.coalesce("head_phrase", F.lit("")), fv.MATCH_STOPWORDS))
        .withColumn("figures", numerics.type_digits(F.col("numerics")))
        .withColumn("kinds", F.array_distinct(F.col("numerics.type"))),
        CLAIM_KEYS, "c_",
        ["topic_terms", "generic_terms", "phrases", "head_phrase", "head_marked",
         "head_terms", "region", "category", "figures", "kinds"])


def _passage_side(passages: DataFrame, **more: Column) -> DataFrame:
    """What the rules read of a passage, and ``more``; each is computed once per passage."""
    return _side(
        text.once(passages, marked=_mark_words(F.col("norm")),
                  figures=numerics.type_digits(F.col("numerics")),
                  kinds=F.array_distinct(F.col("numerics.type")), **more),
        [*PASSAGE_KEYS, *more], "p_",
        ["topic_terms", "generic_terms", "phrases", "marked", "region", "category",
         "figures", "kinds"])


_OUTCOME = ("package_id", "claim_id", "source_ref", "passage_ord", "supports", "agrees",
            "score", "reasons")


def match_pairs(pairs: DataFrame, claims: DataFrame, passages: DataFrame,
                profile: Profile, refused: bool = True) -> DataFrame:
    """Run the staged rules on given pairs.

    Order: region, category, head concept, topic terms, quantities.  Returns
    supports, agrees (NULL when no comparable figure), score and reasons; without
    ``refused`` only the pairs that come to the quantities.
    """
    joined = pairs.join(shuffled(_claim_side(claims)), CLAIM_KEYS).join(
        shuffled(_passage_side(passages)), PASSAGE_KEYS)
    return _staged(joined, profile, refused).select(*_OUTCOME)


def _match_within(claims: DataFrame, passages: DataFrame, profile: Profile,
                  refused: bool) -> DataFrame:
    """The staged rules on every pair of a package, joined on the package alone."""
    fits = (_scopes_meet(F.col("c_region"), F.col("p_region"), profile)
            & compatible_categories(F.col("c_category"), F.col("p_category")))
    every = _claim_side(claims).join(
        shuffled(_passage_side(passages)), "package_id").where(fits)
    return _staged(every, profile, refused).where("_shared > 0 or _head").select(*_OUTCOME)


def _match_beside(claims: DataFrame, passages: DataFrame, profile: Profile,
                  refused: bool) -> DataFrame:
    """The staged rules on the pairs of ``candidates``, tested where the passages lie.

    For few claims: their keys and concepts go to every task, and no passage is shuffled.
    A pair that shares several keys is met at each and kept at the first.  Keys are compared
    as hashes, which can only let pairs in that the rules then judge by their texts.
    """
    asked = claims.select(F.explode("topic_terms").alias("term")).distinct()
    term_counts = passages.select(F.explode("topic_terms").alias("term")).join(
        F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("passages"))
    keys = _claim_keys(claims, term_counts).groupBy(*CLAIM_KEYS).agg(
        F.collect_set(F.xxhash64("key")).alias("_c_keys"))
    terms = F.transform("c_topic_terms", lambda t: F.xxhash64(F.concat(F.lit("t:"), t)))
    side = cut_lineage(_claim_side(claims).withColumn("_c_terms", terms).join(keys, CLAIM_KEYS))
    found = _passage_side(passages, _p_keys=F.transform(
        _passage_keys(), lambda k: F.xxhash64(k)))
    met = found.select("*", F.explode("_p_keys").alias("key")).join(F.broadcast(side.select(
        *CLAIM_KEYS, "_c_keys", F.col("c_region").alias("_region"),
        F.col("c_category").alias("_category"), F.explode("_c_keys").alias("key"))),
        ["package_id", "key"])
    first = F.get(F.array_intersect("_p_keys", "_c_keys"), F.lit(0)) == F.col("key")
    fits = (_scopes_meet(F.col("_region"), F.col("p_region"), profile)
            & compatible_categories(F.col("_category"), F.col("p_category")))
    pairs = met.where(fits & first).drop("key", "_c_keys", "_region", "_category").join(
        F.broadcast(side.drop("_c_keys")), CLAIM_KEYS)
    if not refused:
        enough = F.size(F.array_intersect("_p_keys", "_c_terms")) >= _needed(
            F.size("c_topic_terms"))
        pairs = pairs.where(enough | _headed())
    return _staged(pairs, profile, refused).select(*_OUTCOME)


def _headed() -> Column:
    return (F.coalesce(F.col("p_marked").contains(F.col("c_head_marked")), F.lit(False))
            | (F.col("c_head_phrase").isNotNull() & F.arrays_overlap("c_phrases", "p_phrases")))


def _staged(joined: DataFrame, profile: Profile, refused: bool = True) -> DataFrame:
    n_terms = F.size("c_topic_terms")
    counted = text.once(
        joined,
        _shared=F.size(F.array_intersect("c_topic_terms", "p_topic_terms")),
        _head=_headed(),
        _rest=F.array_except("c_topic_terms", "c_head_terms"),
        _kinds=F.array_intersect("c_kinds", "p_kinds"))
    measured = text.once(
        counted,
        _coverage=F.when(n_terms > 0, F.col("_shared") / n_terms).otherwise(0.0),
        _rest_share=F.when(F.size("_rest") > 0, F.size(
            F.array_intersect("_rest", "p_topic_terms")) / F.size("_rest")))
    shared, coverage, head = F.col("_shared"), F.col("_coverage"), F.col("_head")
    absent = F.when(F.col("c_head_phrase").isNotNull(), F.array(
        F.lit("HEAD_CONCEPT_ABSENT"))).otherwise(text.string_array([]))
    few = n_terms < fv.MIN_TOPIC_OVERLAP
    other_predicate = head & (F.coalesce(F.col("_rest_share"), F.lit(1.0))
                              < fv.MIN_PREDICATE_COVERAGE)
    weak = ~head & ~(few & (coverage >= 1.0)) & (
        (shared < fv.MIN_TOPIC_OVERLAP) | (coverage < fv.MIN_TOPIC_COVERAGE))

    def labels(*names: str) -> Column:
        return text.string_array(names)

    refusal = (
        F.when(~_scopes_meet(F.col("c_region"), F.col("p_region"), profile),
               labels("REGION_MISMATCH"))
        .when(~compatible_categories(F.col("c_category"), F.col("p_category")),
              labels("CATEGORY_MISMATCH"))
        .when(other_predicate,
              labels("MATCHED_HEAD_CONCEPT", "INSUFFICIENT_TOPIC_ALIGNMENT"))
        .when(~head & (shared == 0), F.concat(
            F.when(F.arrays_overlap("c_generic_terms", "p_generic_terms"),
                   labels("GENERIC_OVERLAP_ONLY"))
            .otherwise(labels("INSUFFICIENT_TOPIC_ALIGNMENT")), absent))
        .when(weak, F.concat(labels("INSUFFICIENT_TOPIC_ALIGNMENT"), absent))
    )
    score = (
        F.when(F.col("_refusal").isNull(),
               F.when(head, 0.7 + 0.3 * coverage)
               .when(few, 0.6).otherwise(0.4 + 0.5 * coverage))
        .when(other_predicate, 0.5 * F.col("_rest_share"))
        .when(weak, 0.5 * coverage).otherwise(0.0)
    )
    # Quantities are compared only once both texts are about the same thing.
    comparable = F.size("_kinds") > 0
    same = F.arrays_overlap(
        _values(F.col("c_figures")),
        _values(F.filter("p_figures", lambda f: F.array_contains(
            F.col("_kinds"), F.substring_index(f, ":", 1)))))
    figure = (
        F.when(F.size("c_kinds") == 0, "none")
        .when(~comparable, "NUMERIC_TYPE_MISMATCH")
        .when(same, "NUMERIC_AGREES").otherwise("NUMERIC_DISAGREES")
    )
    matched = F.when(head, "MATCHED_HEAD_CONCEPT").otherwise("MATCHED_TOPIC_TERMS")
    allowed = F.col("_refusal").isNull()
    decided = text.once(measured, _refusal=refusal)
    return (
        (decided if refused else decided.where(allowed))
        .withColumn("score", score)
        .withColumn("_figure", F.when(allowed, figure))
        .withColumn("supports", F.coalesce(
            F.col("_figure").isin("none", "NUMERIC_AGREES"), F.lit(False)))
        .withColumn("agrees", F.when(F.col("_figure") == "NUMERIC_AGREES", True)
                    .when(F.col("_figure") == "NUMERIC_DISAGREES", False))
        .withColumn("reasons", F.coalesce(F.col("_refusal"), F.array_compact(F.array(
            matched, F.when(F.col("_figure") != "none", F.col("_figure"))))))
    )


def _values(figures: Column) -> Column:
    return F.transform(figures, lambda f: F.substring_index(f, ":", -1))


def match(claims: DataFrame, passages: DataFrame, profile: Profile,
          refused: bool = True) -> DataFrame:
    """Pairs that support a claim or disagree with it, with ``refused`` also candidates
    that the rules refuse.

    A package of at most ``SMALL_PACKAGE`` pairs is compared whole: that is at most 25
    pairs for each of its rows, fewer than its keys would find and find again.  The index
    serves the other packages.  How many there are of each is counted first, so that
    neither way runs over nothing.  Claims of at most ``FEW_CLAIMS`` characters in all are
    looked up beside the passages, others by a join on keys.
    """
    sizes = cut_lineage(
        passages.groupBy("package_id").agg(F.count("*").alias("p")).join(shuffled(
            claims.groupBy("package_id").agg(F.count("*").alias("c"))), "package_id")
        .select("package_id", (F.col("p") * F.col("c") <= SMALL_PACKAGE).alias("_small")))
    kinds = {r["_small"] for r in sizes.select("_small").distinct().collect()}

    def only(rows: DataFrame, small: bool) -> DataFrame:
        if len(kinds) < 2:
            return rows
        return rows.join(
            shuffled(sizes.where(F.col("_small") == small)), "package_id", "left_semi")

    def indexed() -> DataFrame:
        found, said = only(passages, False), only(claims, False)
        if said.agg(F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()[0] <= FEW_CLAIMS:
            return _match_beside(said, found, profile, refused)
        return match_pairs(
            candidates(said, found, profile, refused), said, found, profile, refused)

    def whole() -> DataFrame:
        return _match_within(only(claims, True), only(passages, True), profile, refused)

    if True not in kinds:
        return indexed()
    return whole().unionByName(indexed()) if False in kinds else whole()


def figure_postings(texts: DataFrame, *keys: str) -> DataFrame:
    """The typed figures of texts that ``concepts`` has read: package_id, type, digits and
    the keys that name the text, each once."""
    return texts.select("package_id", *keys, F.explode("numerics").alias("n")).select(
        "package_id", *keys, "n.type", "n.digits").distinct()


def figure_spread(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """For each figure of a claim, how many sources of the package state the same value of
    its type, how many another one, and how many other values there are.

    Works on counts per (package, type) and per (package, type, value), never on pairs of
    claim and passage: a source states another value unless the asked one is its only one.
    """
    stated = figure_postings(passages, "source_ref")
    only = stated.groupBy("package_id", "type", "source_ref").agg(
        F.when(F.count("*") == 1, F.first("digits")).alias("only"))
    kinds = only.groupBy("package_id", "type").agg(F.count("*").alias("sources"))
    values = stated.groupBy("package_id", "type", "digits").agg(F.count("*").alias("same"))
    alone = only.where("only is not null").groupBy(
        "package_id", "type", F.col("only").alias("digits")).agg(F.count("*").alias("alone"))
    spread = values.groupBy("package_id", "type").agg(F.count("*").alias("values"))
    known = {name: F.coalesce(F.col(name), F.lit(0)) for name in (
        "sources", "same", "alone", "values")}
    kind, value = ["package_id", "type"], ["package_id", "type", "digits"]
    return (
        figure_postings(claims, "claim_id")
        .join(shuffled(kinds.join(shuffled(spread), kind)), kind, "left")
        .join(shuffled(values.join(shuffled(alone), value, "left")), value, "left")
        .select("package_id", "claim_id", "type", "digits",
                known["same"].alias("same_sources"),
                (known["sources"] - known["alone"]).alias("other_sources"),
                (known["values"] - F.when(known["same"] > 0, 1).otherwise(0))
                .alias("other_values")))
