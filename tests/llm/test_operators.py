"""Each operator against a plain version, on awkward rows and on an empty table."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from probatio.llm import (
    bagminhash, bpe, cascade, chat, exact, langid, mixing, sharding, shingles, templates, viterbi,
)
from probatio.llm.common import table

import llm_helpers as h
from llm_helpers import SF

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return h.awkward(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return h.awkward(spark).limit(0)


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"]) for r in df.select("doc_id").collect())


# 1 mixing


def test_mix_meets_targets(docs):
    rows = mixing.taken(mixing.mix(docs, (5, 2, 1))).collect()
    assert len(rows) == len(h.AWKWARD)
    by = defaultdict(list)
    for r in rows:
        by[r["key"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    assert total == sum(len(h.words(t)) for _, t, *_ in h.AWKWARD)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    for group in by.values():
        assert sum(r["taken"] for r in group) == int(group[0]["target"])
        assert sum(r["size"] for r in group) == group[0]["source_size"]


def test_mix_with_a_floor_keeps_every_document_with_words(docs, none):
    mixed = mixing.mixed_documents(docs, (5, 2, 1), least=1)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for doc_id, text, *_ in h.AWKWARD:
        assert (copies[doc_id] >= 1) == bool(h.words(text))
    assert mixing.mixed_documents(none, (5, 2, 1)).count() == 0
    assert mixing.taken(mixing.mix(none, (5, 2, 1))).count() == 0


def test_schedule_spreads_each_source(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 50).alias("text"),
        F.when(F.col("id") < 2800, "hot").otherwise(F.concat(F.lit("s"), (
            F.col("id") % 4).cast("string"))).alias("source"))
    pieces = mixing.mix(docs, (1,), share=1.0, block_tokens=500).where("slot is not null")
    slots = {(r["key"], r["block"]): r["slot"] for r in pieces.collect()}
    assert len(set(slots.values())) == len(slots)  # a slot has one block
    hot = sorted(v for (k, _), v in slots.items() if k == "shot")
    last = max(slots.values())
    for part in range(1, 8):  # about as many in each eighth of the schedule
        count = sum(v <= last * part / 8 for v in hot)
        assert abs(count - len(hot) * part / 8) <= 8


def test_targets_stop_and_excess_is_shared(spark):
    sources = spark.createDataFrame(
        [("a", 10, 5.0), ("b", 1000, 2.0), ("c", 1000, 1.0)],
        "source string, source_size long, weight double")
    found = {r["source"]: r["target"] for r in mixing.solve_targets(
        sources, 1.5, 0, 2).collect()}
    assert found["a"] == 20
    assert found["b"] == 1996.6666666666667 and found["c"] == pytest.approx(998.33333333)


# 2 language


def test_language_of_held_out_documents(spark):
    run = langid.identify
    rows = table(spark, SF.replace("0.001", "0.01"), "documents").select("doc_id", "text", "lang")
    found = run(rows, rows.where(~langid.held_out())).where(langid.held_out())
    good = found.where(F.col("found.lang_pred") == F.col("lang")).count()
    assert good >= 0.98 * found.count()


def test_language_of_awkward_rows(docs, none):
    found = {r["text"]: r["found2"] for r in langid.identify(
        docs.drop("found"), docs.where("lang is not null")).withColumnRenamed(
        "found", "found2").collect()}
    for text, got in found.items():
        if not any(c.isalpha() for c in text or ""):
            assert got["lang_pred"] == "und" and got["score"] == 0
        assert 0 <= got["score"] <= 1
    assert langid.identify(none, none).count() == 0
    unlabelled = langid.identify(docs, none)
    assert {r["_found"]["lang_pred"] for r in unlabelled.collect()} == {"und"}
    kept = langid.understood(docs, docs)
    assert kept.columns == docs.columns and None not in {r["text"] for r in kept.collect()}


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    texts = ["Ab cd, ef", None, "", "xyz" * 50, "é1é"]
    whole = Counter((g, o) for gs, os in langid.ngrams(texts) for g, o in zip(gs, os))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert whole == Counter((g, o) for gs, os in langid.ngrams(texts) for g, o in zip(gs, os))


def test_masks_counts_and_correction_against_plain_sets(spark, docs):
    """All three steps again with Python sets, over 70 languages and clashing columns."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(n * 100 + i, " ".join(
        letters[(n + i * k) % 26] + letters[n % 26] + letters[n // 26] + letters[k]
        for k in range(1, 12)), f"l{n:02}") for n in range(70) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "*", *(F.lit("x").alias(c) for c in ("chosen_id", "chosen_lang", "found", "bit", "k")))
    grams = {}
    for doc_id, text, _ in rows:
        grams[doc_id] = [int(g) for found, _ in langid.ngrams([text]) for g in found]
    documents = Counter(lang for *_, lang in rows)
    rate = defaultdict(lambda: defaultdict(float))
    for doc_id, _, lang in rows:
        for g in set(grams[doc_id]):
            rate[g][lang] += 1 / documents[lang]
    names = sorted(documents)
    filters = {n: np.zeros(1 << langid.SLOT_BITS, bool) for n in names}
    for g, each in rate.items():
        places = [int(s[0]) for s in langid._slots(np.array([g], np.uint64))]
        for lang, r in each.items():
            if r >= max(each.values()) * langid.SHARE:
                filters[lang][places] = True
    found = {r["doc_id"]: r["found2"] for r in langid.identify(frame.withColumnRenamed(
        "found", "found_"), frame).withColumnRenamed("found", "found2").collect()}
    for doc_id, _, _ in rows:
        places = np.stack(langid._slots(np.array(grams[doc_id], np.uint64)))
        rates = []
        for n in names:
            chance = filters[n].mean() ** langid.PROBES
            share = filters[n][places].all(axis=0).mean()
            rates.append(min(1, max(0, (share - chance) / (1 - chance))))
        assert found[doc_id]["lang_pred"] == names[int(np.argmax(rates))]
        assert found[doc_id]["coverage"] == pytest.approx(max(rates))
        assert found[doc_id]["score"] == pytest.approx(max(rates) / sum(rates))
    kept = langid.understood(frame, frame)
    assert kept.columns == frame.columns and kept.count() == len(rows)
    # without a label there is no language to fail
    named = langid.understood(docs, docs.limit(0))
    assert {r["doc_id"] for r in named.collect()} == {
        i for i, t, *_ in h.AWKWARD if any(c.isalpha() for c in t or "")}


# 3 templates


def test_templates_generalise_fields(spark, docs, none):
    shared = [(i, f"license number {i} held by user{i} of this fine place\n"
               f"{chr(97 + i) * 5} stands in document {chr(97 + i) * 3} only")
              for i in range(12)]
    name = [(100 + i, f"please write to mister {chr(97 + i) * 4} at the front desk here")
            for i in range(12)]
    rows = spark.createDataFrame(shared + name, "doc_id long, text string")
    found = {r["doc_id"]: r for r in templates.drop_recurring_lines(rows, equal_lines=False).collect()}
    assert [found[i]["n_dropped"] for i in range(12)] == [0] + [1] * 11
    assert found[3]["text"] == "ddddd stands in document ddd only"
    # a field that holds another word in each line is variable as well
    assert [found[100 + i]["n_dropped"] for i in range(12)] == [0] + [1] * 11
    same = templates.drop_recurring_lines(docs, equal_lines=False)
    assert same.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert ids(same) == ids(docs) and not same.where("n_dropped > 0").count()
    assert templates.drop_recurring_lines(none).count() == 0


def test_equal_lines_recur_from_two_documents_on(spark, docs, none):
    long = [" ".join(f"{word}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
            for word in ("two", "three")]
    texts = {1: f"{long[0]}\nfirst of all\nMenu", 2: f"  {long[0]}\nsecond 17", 3: long[1],
             4: f"own words here\n{long[1]}\n\n \nsecond 18", 5: f"{long[1]} \nMenu\nmenu",
             6: "again and again here\nagain and again here", 7: None}
    rows = spark.createDataFrame([*texts.items(), (None, long[1])], "doc_id long, text string")
    found = {r["doc_id"]: r for r in templates.drop_recurring_lines(rows).collect()}
    assert {i: r["n_dropped"] for i, r in found.items()} == {
        1: 0, 2: 1, 3: 0, 4: 1, 5: 2, 6: 0, 7: 0, None: 1}
    assert [found[i]["text"] for i in (2, 3, 5, None)] == ["second 17", long[1], "menu", ""]
    assert found[4]["text"] == "own words here\n\n \nsecond 18" and found[7]["text"] is None
    fields = spark.createDataFrame([(i, f"license number {i} of this fine place")
                                    for i in range(12)], "doc_id long, text string")
    assert templates.drop_recurring_lines(fields.where("doc_id < 9")).agg(
        F.sum("n_dropped")).first()[0] == 0
    assert templates.drop_recurring_lines(fields).agg(F.sum("n_dropped")).first()[0] == 11
    same = templates.drop_recurring_lines(docs)
    assert same.columns == [*docs.columns, "n_lines", "n_dropped"] and ids(same) == ids(docs)
    assert templates.drop_recurring_lines(none).count() == 0


# 4 cascade


def test_cascade_counts(docs, none):
    def plain(text):
        w = h.words(text)
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        often, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if often[x] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if h.words(x)]
        return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
                len(lines), len(lines) - len(set(lines)), len(covered))

    for row in cascade.with_counts(docs).collect():
        assert tuple(row[c] for c in cascade.COUNTS) == plain(row["text"]), row["doc_id"]
    judged = cascade.judge(docs)
    assert ids(judged) == ids(docs)
    assert cascade.judge(none).count() == 0


def test_cascade_order_does_not_change_the_verdict(docs, monkeypatch):
    expected = sorted((str(r["doc_id"]), r["kept"]) for r in cascade.judge(docs).collect())
    monkeypatch.setattr(cascade, "ordered_rules", lambda s, r: sorted(r, key=lambda x: x.name)[::-1])
    assert expected == sorted((str(r["doc_id"]), r["kept"]) for r in cascade.judge(docs).collect())


def test_cascade_prefers_rejection_per_second(docs):
    never, always = cascade.Rule("a", F.lit(False)), cascade.Rule("b", F.lit(True))
    assert [r.name for r in cascade.ordered_rules(docs, [never, always])] == ["b", "a"]


# 5 BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def same_as_library(library, texts, coded):
    for text, got in zip(texts, coded, strict=True):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert np.array(wanted, "<u4").tobytes() == got, repr(text)[:80]


def test_bpe_equals_the_library(spark, library, docs):
    rows = docs.select("doc_id", "text").unionByName(
        table(spark, SF, "documents").select("doc_id", "text"))
    coded = bpe.encode_documents(rows, BPE, size=500).collect()
    same_as_library(library, [r["text"] for r in coded], [r["coded"]["ids"] for r in coded])
    for r in coded:
        assert r["coded"]["decoded"] == library.decode(
            np.frombuffer(r["coded"]["ids"], "<u4").tolist(), skip_special_tokens=False)


def test_bpe_equals_the_library_for_all_characters(library):
    tok = bpe.tokenizer(BPE)
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_words([], []), np.uint8))
    chars = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c} {c}1  {c}" for c in chars[i:i + 50])
             for i in range(0, len(chars), 50)]
    same_as_library(library, texts, bpe.encode(texts, tok, lexicon))


def test_bpe_long_texts_are_cut_between_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 8)
    tok = bpe.tokenizer(BPE)
    words = sorted({b" the", b"the", b" of", b" then"})
    lexicon = bpe.Lexicon(np.frombuffer(
        bpe.compile_words(words, [tok.merge(w) for w in words]), np.uint8))
    texts = ["the  of then\n\n the   x ===" + "=" * 100 + " ü" * 30, "", None, " ", "a  "]
    same_as_library(library, texts, bpe.encode(texts, tok, lexicon))


def test_decoding_replaces_broken_bytes(library):
    tok = bpe.tokenizer(BPE)
    broken = library.encode("é€", add_special_tokens=False).ids
    for cut in (broken[:1], broken[1:], broken[::-1], [50256, 188]):
        assert bpe.decode(np.array(cut, "<u4").tobytes(), tok) == library.decode(
            cut, skip_special_tokens=False)


def test_lexicon_is_minimal_and_complete():
    from probatio.llm.lexicon import Lexicon, compile_words

    words = sorted({a + b for a in (b"walk", b"talk", b"stalk") for b in (b"", b"s", b"ed", b"ing")})
    made = Lexicon(np.frombuffer(compile_words(words, [[i] for i in range(len(words))]), np.uint8))
    assert made.places(words).tolist() == list(range(len(words)))
    assert made.places([b"wal", b"walkings", b"", b"x"]).tolist() == [-1] * 4
    assert len(made.final) < 16  # suffixes are shared: a trie would need 39 states


def test_bpe_of_an_empty_table(none):
    assert bpe.encode_documents(none, BPE).count() == 0


# 6 exact


@pytest.mark.parametrize("block", [3, 8192])
def test_exact_groups(docs, block):
    found = exact.deduplicate(docs, block_bytes=block).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in h.AWKWARD:
        groups[h.lower_ascii(text or "")].append(doc_id)
    kept = Counter()
    for r in found:
        sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        members = groups[sha[r["text_sha256"]]]
        assert r["group_size"] == len(members)
        assert r["keep_id"] == max((m for m in members if m is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert len(found) == len(h.AWKWARD) and set(kept.values()) == {1}


def test_exact_survives_colliding_keys(spark, monkeypatch):
    first = exact._keys
    monkeypatch.setattr(exact, "_keys", lambda b, seed: (
        F.lit(1).cast("long"), F.lit(1).cast("long")) if seed == 0 else first(b, seed))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact.deduplicate(rows).collect()} == {
        1: 3, 2: 2, 3: 3}


def test_exact_without_copies(docs, none):
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({h.lower_ascii(t or "") for _, t, *_ in h.AWKWARD})
    assert exact.without_copies(none).count() == 0


# 7 sharding


def test_best_fit_decreasing_against_a_plain_search():
    rng = np.random.default_rng(3)
    items = [(f"i{k}", int(s)) for k, s in enumerate(rng.integers(1, 400, 700))]
    bins = 13
    room = [-(-sum(s for _, s in items) // bins)] * bins
    wanted = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fit = [(r, b) for b, r in enumerate(room) if r >= size]
        _, b = min(fit) if fit else max((r, b) for b, r in enumerate(room))
        room[b] -= size
        wanted[item] = b
    assert sharding.best_fit_decreasing(items, bins) == wanted


def test_shards_are_even_and_keep_groups(spark, none):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(
        F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")),
        F.when(F.col("id") < 2000, "hot").otherwise((F.col("id") / 2).cast("int").cast("string"))
    ).alias("text")).unionByName(spark.createDataFrame(
        [(-1, None), (None, ""), (None, None)], "doc_id long, text string"))
    found = sharding.shard(rows, shards=8).join(
        rows.select(F.col("doc_id").alias("d"), "text"),
        F.col("doc_id").eqNullSafe(F.col("d"))).where("doc_id is not null").toPandas()
    loads = found.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 0.02 * loads.mean() and len(loads) == 8
    assert (found.groupby("text").shard.nunique() == 1).all()
    whole = sharding.shard(rows, shards=8).toPandas()
    for _, part in whole.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard(none).count() == 0


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    loads = sharding.shard(rows, shards=20).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()
    assert len(loads) == 20 and loads.s.max() - loads.s.min() < 0.1 * loads.s.mean()


# 8 token counts


def test_counts_equal_a_unigram_tokenizer(spark, docs, none):
    from tokenizers import Tokenizer, models, normalizers

    pieces = viterbi.read_pieces(PIECES)
    vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", -1e9) for b in range(256)), *pieces.items()]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence(
        [normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rows = docs.select("text").unionByName(table(spark, SF, "documents").select("text"))
    for r in viterbi.count_tokens(rows, PIECES).collect():
        wanted = len(library.encode(r["text"]).ids) if r["text"] else 0
        assert r["counted"]["n_tokens"] == wanted, repr(r["text"])[:80]
    assert viterbi.count_tokens(none, PIECES).count() == 0


@pytest.mark.parametrize("pieces", [
    {"a": -1.0, "b": -1.0, "ab": -2.0, "▁": -1.0, "▁a": -2.0, "ba": -2.0},
    {"▁a▁b": -1.0, "a": -3.0, "b": -3.0, "▁": -1.0, "▁a": -2.0}, {}])
def test_ties_and_scores_by_brute_force(pieces):
    def best(text):  # over all segmentations, left to right, strictly better only
        table = [(0.0, 0)] + [(-np.inf, 0)] * len(text)
        unknown = min(pieces.values(), default=0.0) - 10
        for end in range(1, len(text) + 1):
            for start in range(end):
                piece = text[start:end]
                if piece in pieces:
                    step = (pieces[piece], 1)
                elif end - start == 1:
                    step = (unknown, len(piece.encode()))
                else:
                    continue
                score = table[start][0] + step[0]
                if score > table[end][0]:
                    table[end] = (score, table[start][1] + step[1])
        return table[-1]

    model = viterbi.Unigram(pieces)
    for text in ("ab ab", "abab  ba", " a b", "é a\nb", "bbaab", " "):
        score, count = best("▁" + text.replace(" ", "▁"))
        assert model.count(text) == (count, score)
    assert model.count("") == model.count(None) == (0, 0.0)


# 9 near duplicates


def test_near_duplicates_of_awkward_rows(docs, none):
    found = bagminhash.near_duplicates(docs).where("doc_id is not null").collect()
    wanted = h.near_classes([(i, t) for i, t, *_ in h.AWKWARD if i is not None])
    assert {r["doc_id"]: r["class_id"] for r in found} == wanted
    kept = bagminhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert bagminhash.near_duplicates(none).count() == 0


def test_links_that_no_pivot_shows(spark, monkeypatch):
    """A large group whose members resemble the centre less than 0.8 but come in pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for n in range(40):
        text = list(base)
        for p in rng.choice(240, 7, replace=False):
            text[p] = f"edit{n}.{p}"
        rows.append((2 * n, " ".join(text)))
        text[rng.integers(240)] = f"twin{n}"
        rows.append((2 * n + 1, " ".join(text)))
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    found = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == h.near_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for heavy in (1, 40):
        a = {int(k): int(rng.integers(1, heavy + 1)) for k in rng.integers(0, 2**62, 60)}
        b = {k: max(1, v // 2) for k, v in a.items()} | {int(k): 2 for k in rng.integers(0, 2**62, 5)}
        true = h.jaccard(Counter(a), Counter(b))
        owners = np.repeat([0, 1], [len(a), len(b)])
        signed = bagminhash.signatures(
            np.array([*a, *b], np.uint64), owners, np.array([*a.values(), *b.values()]), 2, 4096)
        assert abs((signed[0] == signed[1]).mean() - true) < 0.04


def test_shingles_against_plain_counts():
    texts = ["", None, "A b", "a B c d e f a b c d e f", "  x\t\ty é É \n" * 7]
    sets = shingles.element_sets([(t or "").encode() for t in texts])
    for i, a in enumerate(texts):
        assert len(sets[i]) == sum(h.shingles(a).values())
        for j, b in enumerate(texts):
            assert bagminhash.jaccard(sets[i], sets[j]) == pytest.approx(
                h.jaccard(h.shingles(a), h.shingles(b)))


# 10 chat


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "message", "user", "Hi"), (1, 1, 2, "message", "assistant", "He"),
        (1, 1, 3, "delta", None, "llo"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "Good "), (1, 1, 6, "delta", None, "day"),
        (1, 0, 7, "edit", None, "Hello"), (1, 1, 6, "delta", None, "day"),
        (2, 0, 1, None, None, None), (None, 0, 1, "delta", "user", "~1<[\n")]
    events = spark.createDataFrame(
        log, "conv_id long, message long, seq long, kind string, role string, text string")
    folded = {(r["conv_id"], r["message"]): (r["role"], r["text"])
              for r in chat.fold(events).collect()}
    assert folded == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "Good daydayday"[:-3]),
                      (2, 0): ("", ""), (None, 0): ("user", "~1<[\n")}
    back = chat.format_conversations(events).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in back:
        wanted = [v for k, v in sorted(folded.items(), key=str) if k[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == wanted
        assert r["loss"] == "".join(t for role, t in wanted if role == "assistant")
    assert chat.format_conversations(events.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "</s>\n[INST]", "~0~1~2~3", "~", "é[/INST]\n</s>", "\n\n"])
def test_template_is_reversible(spark, text):
    events = spark.createDataFrame(
        [(1, n, n, "message", role, text) for n, role in enumerate(
            ("user", "assistant", "a\nb<", "assistant"))],
        "conv_id long, message long, seq long, kind string, role string, text string")
    r = chat.format_conversations(events).select(
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [
        ("user", text), ("assistant", text), ("a\nb<", text), ("assistant", text)]
    assert r["loss"] == 2 * text
