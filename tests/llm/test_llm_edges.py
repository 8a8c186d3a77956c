"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from footfall.llm import (
    byte_bpe,
    chat_format,
    class_lm,
    decontamination,
    near_duplicates,
    quality_classifier,
    quality_rules,
    sharding,
    token_counts,
    url_filter,
)

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " ids int, kept string, shard string, _key int, _n int, n_words string, score string"
)
PROSE = " ".join(f"word{i} of the text and more" for i in range(40))
EXTRA = (7, "x", "y", 1, 2, "z", "s")
ROWS = [
    (1, "", "en", "s", 0, *EXTRA),
    (2, None, None, None, None, *EXTRA),
    (3, PROSE, "en", "s", 1, *EXTRA),
    (3, PROSE, "en", "s", 1, *EXTRA),  # a repeated row
    (4, PROSE, "fr", "s", 1, *EXTRA),  # a copy
    (5, "ab" * 20_000, "xx", "s", 1, *EXTRA),  # one very long word
    (6, (PROSE + "\n") * 300, "en", "s", 1, *EXTRA),  # a very long text
    (None, "a text without id, but not without words " * 20, "en", "s", 1, *EXTRA),
    (8, " \t\n ", "en", "s", 1, *EXTRA),
    (9, "é中😀 <|endoftext|> 'll don't", "en", "s", 1, *EXTRA),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(3, 1, 0), (3, 0, 0), (None, 1, 1), (6, 1, None), (5, None, 1)],
        "doc_id bigint, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "word3 of the text and more word4 of the text"), (2, None), (3, "too short"), (4, "")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


# --- token counts -------------------------------------------------------------------


def test_token_counts(messy, nothing, tokenizer):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_counts.token_counts(messy, tokenizer).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted(
        (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for _, t, *_ in ROWS
    )
    assert token_counts.token_counts(nothing, tokenizer).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        token_counts.token_counts(messy, tokenizer, keep=("n_tokens",))


def test_transducers_on_random_texts(tokenizer):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    letters = [*"stmdrvel' \n\t\r ''aZé1٣!?_-ñ中😀", chr(0x3000), chr(0x1C), chr(0x85), "<|endoftext|>", "'re", " the"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 999, "\n" * 300 + "x", ""]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, tokenizer).tolist() == expected


def test_chunk_maps_compose_to_a_plain_reading():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, token_counts.CLASSES, 40 * token_counts.CHUNK + 17).astype(np.uint8)
    starts, state = token_counts.word_starts(classes, 0)
    now, expected = 0, set()
    for i, c in enumerate(classes):
        now, marks = token_counts._split(now, int(c))
        if marks & token_counts.HERE:
            expected.add(i)
        if marks & token_counts.BEFORE:
            expected.add(i - 1)
    assert (set(starts.tolist()), state) == (expected, now)


def test_blocks_join(tokenizer, monkeypatch):
    text = "it's  we'll\n\n go 'r 're ' x" * 50
    whole = token_counts.count_texts([text, "", text], tokenizer)
    for size in (1, 2, 7, 200):
        monkeypatch.setattr(token_counts, "BLOCK", size)
        assert token_counts.count_texts([text, "", text], tokenizer).tolist() == whole.tolist()


def test_character_classes():
    table = token_counts.character_classes()
    assert table[ord("é")] == token_counts.LETTER and table[ord("٣")] == token_counts.NUMBER
    assert unicodedata.category("_")[0] == "P" and table[ord("_")] == token_counts.OTHER


# --- sharding -----------------------------------------------------------------------


def test_sharding(messy, nothing):
    rows = sharding.sharded(messy, shards=4).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert len(rows) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for s, n in enumerate(sizes):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    none = [r for r in rows if r.doc_id == 2]
    assert [(r.size, r.text_crc32) for r in none] == [(1, 0)]
    assert sharding.sharded(nothing).count() == 0


def test_a_group_of_a_third_is_cut_into_few_shards(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("own "), "id")).alias("text"),
    )
    rows = sharding.sharded(docs, shards=8).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    held = [sum(r.shard == s and r.doc_id % 3 == 0 for r in rows) for s in range(8)]
    # 1000 copies need three shards of 375; at random each of eight would hold 125
    assert sum(n > 0 for n in held) <= 6 and sum(sorted(held)[-4:]) >= 650


def copies(spark, sizes, alone=0):
    rows = [(f"copy {i}",) for i, n in enumerate(sizes) for _ in range(n)]
    rows += [(f"own {i}",) for i in range(alone)]
    return spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id bigint, text string")


def held_by(rows, docs):
    texts, held = {r.doc_id: r.text for r in docs.collect()}, {}
    for r in rows:
        held.setdefault(texts[r.doc_id], []).append(r.shard)
    return held


@pytest.mark.parametrize(
    "sizes, alone, shards, most",
    [
        ([1000], 2000, 8, {0: 3}),  # 1000 rows need three shards of 375
        ([90, 60, 55], 195, 4, {}),  # between half a shard and a whole one
        ([3, 2, 2], 41, 16, {}),  # shards of three rows
        ([12, 3], 25, 16, {0: 4}),  # four of the eight shards that hold three rows
        ([2] * 1200 + [3] * 900, 300, 4, {}),  # rounds, as the groups are small and many
    ],
)
def test_groups_stay_whole_where_they_fit(spark, sizes, alone, shards, most):
    docs = copies(spark, sizes, alone)
    rows = sharding.sharded(docs, shards=shards).collect()
    found = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert len(rows) == sum(sizes) + alone and max(found) - min(found) <= 1
    held = held_by(rows, docs)
    parted = {i: len(set(held[f"copy {i}"])) for i in range(len(sizes))}
    assert {i: n for i, n in parted.items() if n > 1} == most


def test_cut_links_are_told(spark):
    docs = copies(spark, [10, 2], 4)
    ((n_rows, n_shards, n_cut),) = (
        sharding.cut_links(docs, shards=2).select("n_rows", "n_shards", "n_cut").collect()
    )
    assert (n_rows, n_shards, n_cut) == (10, 2, 16)  # eight rows and two
    assert sharding.cut_links(docs.limit(0)).count() == 0


# --- language model -----------------------------------------------------------------


def test_class_lm(messy, nothing, spark):
    rows = class_lm.scored(messy).collect()
    assert len(rows) == len(ROWS)
    assert all(r.score <= 0 and r.base_score <= 0 and r.n_known <= r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 8)} == {1}
    three = [r for r in rows if r.doc_id == 3]
    assert len(three) == 2 and three[0].score == pytest.approx(three[1].score)
    assert class_lm.scored(nothing).count() == 0
    # only held-out documents: nothing to learn from
    held = spark.range(100).where("crc32(cast(id as string)) % 7 = 2")
    held = held.select(F.col("id").alias("doc_id"), F.lit("never seen").alias("text"))
    assert {(r.n_known, r.train_tokens) for r in class_lm.scored(held).collect()} == {(0, 0)}


def test_probabilities_add_up(messy):
    training = class_lm.training_texts(messy)
    counts = class_lm.word_counts(training).cache()
    model = class_lm.trained(training, counts)
    assert (10**model.transitions).sum(axis=1) == pytest.approx(np.ones(class_lm.CLASSES))
    of = np.bincount(model.classes.of_word, 10**model.emissions, minlength=class_lm.EXCHANGED)
    assert all(x == pytest.approx(1) or x == 0 for x in of[: class_lm.EXCHANGED])


def test_a_word_is_exchanged_by_its_own_count(spark, monkeypatch):
    """Five occurrences suffice, however large the input is and however long the word."""
    monkeypatch.setattr(class_lm, "BLOCK", 7)  # several blocks
    filler = "the cat sat on a mat and " * 2000
    long = "x" * 300
    texts = [f"{filler} seldom {long} {long}y"] * 5 + ["once twice"] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    counts = class_lm.word_counts(docs.select(F.col("text").cast("binary").alias("text"))).cache()
    keys = {bytes(r["_key"]) for r in class_lm.frequent(counts).collect()}
    expected = {b"the", b"cat", b"sat", b"on", b"a", b"mat", b"and", b"seldom"}
    assert keys == expected | {class_lm._key(w.encode()) for w in (long, f"{long}y")}
    read, vocabulary = class_lm.numbered(
        docs.select("doc_id", F.col("text").cast("binary").alias("text")), counts
    )
    rows = {r.doc_id: r for r in read.collect()}
    assert sorted(vocabulary.seen) == [5] * 3 + [10_000] * 7
    assert all(rows[i].rest == [] and rows[i].known == 14_003 for i in range(5))
    assert all([bytes(w) for w in rows[i].rest] == [b"once", b"twice"] for i in range(5, 9))
    numbers = np.frombuffer(rows[0].numbers, np.int32)
    assert (numbers[:7] == numbers[7:14]).all() and set(numbers) == set(range(10))
    assert rows[0].logs == pytest.approx(np.log10(vocabulary.seen[numbers]).sum())
    # blocks don't change the scores
    some = {r.doc_id: r.score for r in class_lm.scored(docs).collect()}
    monkeypatch.setattr(class_lm, "BLOCK", 1 << 20)
    whole = {r.doc_id: r.score for r in class_lm.scored(docs).collect()}
    assert some == pytest.approx(whole)


# --- URLs ---------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = [
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com/de", "example.com", "/de", "com/", "allow"),
        ("http://com", "com", "", None, None),
        ("x://a.net/es/://b", "a.net", "/es/://b", "net/es/", "block"),
        ("http://planet/es/", "planet", "/es/", None, None),
        ("http://ÄB.net/fr/\n", "Äb.net", "/fr/\n", "net/fr/", "block"),
        ("mailto:someone", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    pages = spark.createDataFrame(
        [(i, u[0], "own") for i, u in enumerate(urls)], "page_id bigint, url string, n string"
    )
    rows = {r.page_id: r for r in url_filter.filtered(pages.union(pages)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.filtered(pages.union(pages)).count() == 2 * len(urls)
    assert url_filter.filtered(pages.limit(0)).count() == 0


def test_url_model_learns(spark):
    good = [(i, f"http://site{i}.com/article/{i}") for i in range(200)]
    bad = [(1000 + i, f"http://casino{i}.net/es/win-{i}") for i in range(200)]
    new = [(5000, "http://site7.org/article/9"), (5001, "http://casino7.org/es/win-9")]
    pages = spark.createDataFrame(good + bad + new, "page_id bigint, url string")
    rows = {r.page_id: r.verdict for r in url_filter.filtered(pages).collect()}
    assert (rows[5000], rows[5001]) == ("allow", "block")


# --- chat ---------------------------------------------------------------------------


def test_events_fold(spark):
    log = spark.createDataFrame(
        [
            (1, 0, 0, "start", "user", None),
            (1, 0, 1, "delta", None, "Hel"),
            (1, 0, 2, "delta", None, "lo"),
            (1, 1, 3, "start", "assistant", None),
            (1, 1, 4, "delta", None, "bad answer"),
            (1, 2, 5, "start", "user", None),
            (1, 2, 6, "delta", None, "to be gone"),
            (1, 1, 7, "regenerate", None, None),
            (1, 1, 8, "delta", None, "good "),
            (1, 1, 9, "delta", None, "answer"),
            (1, 3, 10, "start", "user", None),
            (1, 3, 11, "delta", None, "thx"),
            (1, 3, 12, "edit", None, "thanks"),
            (1, 3, 13, "delta", None, "!"),
            (None, 0, 0, "start", None, None),
        ],
        "conv_id bigint, message int, seq int, kind string, role string, text string",
    )
    pieces = chat_format.formatted(log.orderBy(F.rand(1))).collect()
    texts = {}
    for r in pieces:
        texts.setdefault(r.conv_id, []).extend(
            (chat_format._role(h), chat_format.unescape(t))
            for h, t in chat_format._TURN.findall(r.piece)
        )
    assert texts[1] == [("user", "Hello"), ("assistant", "good answer"), ("user", "thanks!")]
    assert texts[None] == [("", "")]
    masked = [r.piece[r.loss_begin : r.loss_end] for r in pieces if r.loss_end > r.loss_begin]
    assert masked == ["good answer"]


def test_messages_of_one_conversation_are_spread(spark):
    """Folding and rendering don't send a conversation through one task."""
    rows = [(1, i // 3, i, "delta" if i % 3 else "start", "user", f"part {i} ") for i in range(3000)]
    rows += [(1, 500, 5000, "regenerate", None, "anew")]
    names = "conv_id bigint, message int, seq int, kind string, role string, text string"
    log = spark.createDataFrame(rows, names)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folded = chat_format.standing(log)
        tasks = folded.select("message", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert sorted(r.message for r in tasks) == list(range(501))
    assert len({r.task for r in tasks}) > 1
    texts = {r.message: r["_text"] for r in folded.collect()}
    assert texts[500] == "anew" and texts[499] == "part 1497 part 1498 part 1499 "


def test_turn_logs(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", None), (1, 0, None, "a\nb"), (1, 0, None, "a\nb"), (2, None, "user", "x" * 5000)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    log = chat_format.log_of_turns(turns)
    rows = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(log)).collect()}
    assert (rows[1].n_turns, rows[1].loss_chars, rows[2].n_turns) == (3, 0, 1)
    none = chat_format.read_back(chat_format.formatted(chat_format.log_of_turns(turns.limit(0))))
    assert none.count() == 0


def test_turn_logs_hold_all_kinds_of_events(spark):
    turns = [(i, t, "assistant" if t % 2 else "user", f"turn {t} of {i} " * (40 * t)) for i in range(30) for t in range(4)]
    docs = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    log = chat_format.log_of_turns(docs).cache()
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"start", "delta", "edit", "regenerate"} and min(kinds.values()) >= 20
    assert log.where("text = 'to be gone'").count() >= 20
    assert log.where("text like 'draft %'").count() >= 40
    found = chat_format.standing(log).orderBy("conv_id", "message").collect()
    given = [(i, r, t) for i, _, r, t in turns]
    assert [(r.conv_id, r["_role"], r["_text"]) for r in found] == given


def test_escaping_is_reversible():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choices("<|\\\nab im_end>", k=rng.randint(0, 12)))
        role = "".join(rng.choices("<|\\\nnab", k=rng.randint(0, 6)))
        piece, *_ = chat_format.render(role, text)
        ((header, body),) = chat_format._TURN.findall(piece)
        assert (chat_format._role(header), chat_format.unescape(body)) == (role, text)


# --- quality ------------------------------------------------------------------------


def test_quality_rules(messy, nothing):
    rows = quality_rules.rules(messy).collect()
    assert len(rows) == len(ROWS)
    empty = [r for r in rows if r.doc_id in (1, 2, 8)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in empty)
    assert quality_rules.rules(nothing).count() == 0
    kept = quality_rules.kept_documents(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(
        r.doc_id for r in rows if r.kept
    )
    assert quality_rules.kept_documents(nothing).count() == 0


def test_distance(spark):
    df = spark.createDataFrame(
        [([1, 0], [5, 0]), ([1, 0], [0, 9]), ([0, 0], [1, 1])], "a array<bigint>, b array<bigint>"
    )
    found = [r[0] for r in df.select(quality_rules.distance(F.col("a"), F.col("b"))).collect()]
    assert found[0] == pytest.approx(0) and found[1] == pytest.approx(1) and found[2] is None


def test_quality_classifier(messy, nothing, labels):
    rows = quality_classifier.classified(messy, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.p_good <= 1 for r in rows)
    kept = quality_classifier.kept_documents(messy, labels)
    assert kept.columns == messy.columns
    assert quality_classifier.classified(nothing, labels).count() == 0
    # without ratings everything is held for good
    assert all(r.kept for r in quality_classifier.classified(messy, labels.limit(0)).collect())
    graded = {r.doc_id: r.grade for r in quality_classifier.grades(labels).collect()}
    assert graded == {3: 1, 6: 2}


def test_classifier_learns_from_the_ends_of_long_texts(spark, monkeypatch):
    clean = "word of the text " * 12_000
    assert len(clean) > 200_000
    rows = [(i, clean + ("vile" if i % 3 == 0 else "fine")) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, 1, int(i % 3 == 0)) for i in range(12)], "doc_id bigint, quality int, toxic int"
    )
    fitted = []
    monkeypatch.setattr(quality_classifier, "fit", lambda found, grades: fitted.append((found, grades)))
    quality_classifier.trained(docs, labels)
    ((found, grades),) = fitted
    vile = quality_classifier._Hashes()["vile"]
    assert sorted(grades) == [0] * 4 + [2] * 8
    assert [vile in f for f in found] == [g == 0 for g in grades]
    # a text teaches the features by which it is scored
    whole = {tuple(quality_classifier.features(t, quality_classifier._Hashes())) for _, t in rows}
    assert {tuple(f) for f in found} == whole


# --- near duplicates ----------------------------------------------------------------


def test_near_duplicates(messy, nothing):
    rows = near_duplicates.near_duplicates(messy).collect()
    classes = {(r.doc_id, r.class_id) for r in rows}
    assert len(rows) == len(ROWS)
    assert {(3, 3), (4, 3), (2, 1), (1, 1), (None, None)} <= classes
    assert near_duplicates.near_duplicates(nothing).count() == 0
    kept = near_duplicates.representatives(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len({r.class_id for r in rows})


def test_near_copies_in_a_large_group(spark):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        copy = list(words)
        copy[i] = f"other{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"x{i}y{j}" for j in range(100))) for i in range(50)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    classes = {r.doc_id: r.class_id for r in found.collect()}
    assert all(classes[i] == 0 for i in range(150))
    assert all(classes[1000 + i] == 1000 + i for i in range(50))


def test_alignment_matches_the_full_table():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.randint(0, rng.choice([2, 8, 100])) for _ in range(rng.randint(1, 50))]
        b = list(a)
        for _ in range(rng.randint(0, 7)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = [rng.randint(0, 100)] * rng.randint(0, 2)
        m = common(a, b)
        exact, got = m / (len(a) + len(b) - m), near_duplicates.similarity(a, b)
        assert got == pytest.approx(exact) if exact >= 0.8 else got < 0.8


# --- byte-level BPE -----------------------------------------------------------------


def test_byte_bpe(messy, nothing, vocabulary):
    import tiktoken

    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={}
    )
    encoded = byte_bpe.encode(messy, vocabulary, public_tokenizers.PATTERN, max_words=3)
    rows = encoded.withColumn("back", byte_bpe.decoded(F.col("ids"), vocabulary)).collect()
    given = {(i, t or "") for i, t, *_ in ROWS}
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, bytes(r.back).decode()) for r in rows} == given
    for r in rows:
        assert r.ids == library.encode_ordinary(bytes(r.back).decode())
    assert byte_bpe.encode(nothing, vocabulary, public_tokenizers.PATTERN).count() == 0


def test_heap_merges_like_the_fold(vocabulary):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocabulary, special_tokens={})
    pairs, rng = byte_bpe.pair_ranks(vocabulary), random.Random(4)
    for _ in range(200):
        word = bytes(rng.choices(b"abethins   ", k=rng.randint(1, 400)))
        ids = byte_bpe.merge_long([vocabulary[word[i : i + 1]] for i in range(len(word))], pairs)
        assert ids == library.encode_ordinary(word.decode())


def test_rank_map_finds_pairs_and_nothing_else(vocabulary):
    pairs, rng = byte_bpe.pair_ranks(vocabulary), random.Random(5)
    shifts, entries = (x.to_pylist() for x in byte_bpe.rank_map(pairs, 16))
    low, tokens = -1 << 31, len(vocabulary)
    others = [(rng.randrange(tokens), rng.randrange(tokens)) for _ in range(50_000)]
    others += [(right, left) for left, right in pairs]
    for left, right in [*pairs, *others]:
        shift = shifts[(left * 8191 + right) % 65521]
        place = len(entries) if shift is None else shift + left
        entry = entries[place] if place < len(entries) else None
        turned = left << 16 if left < 1 << 15 else (left << 16) - (1 << 32)
        found = None if entry is None else entry ^ turned
        if (left, right) in pairs:
            assert found == low + pairs[left, right]
        else:
            assert found is None or found >= low + (1 << 16)


def test_ids_beyond_two_bytes(messy, vocabulary):
    more = {token: rank + 100_000 for token, rank in vocabulary.items()}
    few = byte_bpe.encode(messy.where("doc_id is not null"), vocabulary, public_tokenizers.PATTERN)
    many = byte_bpe.encode(messy.where("doc_id is not null"), more, public_tokenizers.PATTERN)
    expected = sorted((r.doc_id, [i + 100_000 for i in r.ids]) for r in few.collect())
    assert sorted((r.doc_id, r.ids) for r in many.collect()) == expected


def test_plan_does_not_hold_the_rank_map(messy, vocabulary):
    encoded = byte_bpe.encode(messy, vocabulary, public_tokenizers.PATTERN)
    assert len(encoded._jdf.queryExecution().toString()) < 1 << 18


def test_words_are_cut_where_no_token_spans(vocabulary):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocabulary, special_tokens={})
    beside = {token[i : i + 2] for token in vocabulary for i in range(len(token) - 1)}
    pairs, rng = byte_bpe.pair_ranks(vocabulary), random.Random(6)
    words = ["".join(rng.choices("abethinßéü京😀 q", k=rng.randint(0, 30))) for _ in range(500)]
    parts, counts = byte_bpe._Cutter(vocabulary).parts(words)
    assert len(parts) > 1.5 * len(words)
    assert all(p[i : i + 2] in beside for p in parts for i in range(len(p) - 1))
    at = 0
    for word, count in zip(words, counts.tolist(), strict=True):
        own, at = parts[at : at + count], at + count
        assert b"".join(own) == word.encode()
        assert not any(p[-1:] + q[:1] in beside for p, q in zip(own, own[1:], strict=False))
        alone = [byte_bpe.merge_long([vocabulary[bytes([b])] for b in p], pairs) for p in own]
        assert [i for ids in alone for i in ids] == library.encode_ordinary(word)
    assert at == len(parts)


def test_words_share_their_parts(spark):
    import tiktoken

    few = {bytes([b]): b for b in range(256)}
    for token in (b"ab", b"cd", b"aa", b"cdc", b"aab", b"aaaa"):
        few[token] = len(few)
    texts = ["abcd cdab", None, "abab cdab", "", "aaaaab cdcdcdaabab" * 3, "ab" * 300, "\u00e9a\u00e9"]
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(texts))), "text": pa.array(texts)})
    for max_words in (1, 1 << 20):
        (out,) = byte_bpe._number_words("text", public_tokenizers.PATTERN, few, max_words)(iter([batch]))
        told = [[[x & 255 for x in part] for part in row] for row in out.column("_new").to_pylist()]
        # "ab", "cd" and " " are folded once for all the words that they are in.
        if max_words > 1:
            assert told[:4] == [[[*b"ab"], [*b"cd"], [*b" "]], [], [], []]
    for more in (0, 100_000):
        ranks = {token: rank + more for token, rank in few.items()}
        library = tiktoken.Encoding(
            "few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=few, special_tokens={}
        )
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        for max_words in (1, 2, 1 << 20):
            rows = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, max_words=max_words)
            for r in rows.collect():
                expected = library.encode_ordinary(texts[r.doc_id] or "")
                assert r.ids == [i + more for i in expected]


def test_ids_are_made_in_parts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART_WORDS", 10)
    rows = 40
    batch = pa.RecordBatch.from_pydict(
        {
            "k": pa.array(range(rows)),
            "_words": pa.array([[0, 1, i] for i in range(rows)], pa.list_(pa.int32())),
            "_encoded": pa.array(
                [[[5], [6, 7], [8]]] + [[]] + [[[i]] for i in range(3, rows + 1)],
                pa.list_(pa.list_(pa.int32())),
            ),
            "_fresh": pa.array([False] * rows),
        }
    )
    parts = list(byte_bpe._assemble(["k"], "ids")([batch]))
    assert len(parts) > 5 and max(p.num_rows for p in parts) <= 4
    words = [[5], [6, 7], [8], *([i] for i in range(3, rows + 1))]
    ids = [r for p in parts for r in p.column("ids").to_pylist()]
    assert ids == [[*words[0], *words[1], *words[i]] for i in range(rows)]


# --- decontamination ----------------------------------------------------------------


def test_decontamination(messy, nothing, items):
    rows = decontamination.leaks(messy, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(3, 1), (4, 1), (6, 1)}
    assert all(r.containment == 1 for r in rows)
    clean = decontamination.clean_documents(messy, items)
    assert clean.columns == messy.columns and clean.count() == len(ROWS) - 4
    assert decontamination.leaks(nothing, items).count() == 0
    assert decontamination.leaks(messy, items.limit(0)).count() == 0
    assert decontamination.clean_documents(messy, items.limit(0)).count() == len(ROWS)


def test_containment_at_the_limit(spark):
    item = [f"b{i}" for i in range(44)]  # 40 shingles
    inside = [f"f{i}" for i in range(3000)]
    edge, beyond = list(item), list(item)
    edge[0], edge[43] = "x", "y"  # 38 of 40 are left
    for at in (5, 20, 35):
        beyond[at] = "z"  # 25 of 40 are left
    docs = [(1, inside + item), (2, edge + inside), (3, inside[:100] + beyond + inside)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    rows = {r.doc_id: r.containment for r in decontamination.leaks(docs, items).collect()}
    assert rows == {1: pytest.approx(1.0), 2: pytest.approx(38 / 40)}


def test_items_without_id_and_of_one_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(12)) for c in "xyz")
    documents = spark.createDataFrame(
        [(1, f"before {one} after"), (2, two), (3, f"{two} and {three}"), (4, "nothing of it")],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame(
        [(None, one), (None, one), (7, two), (7, three), (8, two)], "item_id bigint, text string"
    )
    rows = [tuple(r) for r in decontamination.leaks(documents, items).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, None, 1.0), (2, 7, 1.0), (2, 8, 1.0), (3, 7, 1.0), (3, 8, 1.0)], key=str
    )
    assert [r.doc_id for r in decontamination.clean_documents(documents, items).collect()] == [4]


# --- quality rules on short texts -----------------------------------------------------


@pytest.mark.parametrize("lang", sorted(quality_rules.COMMON_WORDS))
def test_texts_without_common_words_are_rejected_from_50_words_on(spark, lang):
    rng = random.Random(lang)
    common = quality_rules.COMMON_WORDS[lang]
    rare = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(4, 9))) for _ in range(4000)]

    def prose(n, share):
        words = [rng.choice(common) if rng.random() < share else rng.choice(rare) for _ in range(n)]
        return " ".join(words).capitalize() + "."

    good = [(i, prose(n, 0.16)) for i, n in enumerate([60, 75, 100, 150, 200, 400, 900] * 30)]
    bad = [(1000 + n, prose(n, 0)) for n in (50, 51, 60, 80, 120, 170, 185, 300, 1000)]
    documents = spark.createDataFrame([(i, t, lang, 7) for i, t in good + bad], "doc_id long, text string, lang string, _t int")
    rows = {r.doc_id: r for r in quality_rules.rules(documents, keep=("doc_id", "_t")).collect()}
    assert all(rows[i]._t == 7 for i in rows)
    assert not any(rows[i].kept for i, _ in bad)
    assert not any(rows[i].base_failed for i, _ in bad)
    assert sum(rows[i].kept for i, _ in good) >= 0.99 * len(good)


def test_rated_good_texts_stay_and_rated_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality_rules.rules(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    rated = spark.read.parquet(f"{sf}/labels.parquet").collect()
    judged = [(rows[r.doc_id], r) for r in rated if not rows[r.doc_id].base_failed]
    good = [x.kept for x, r in judged if r.quality and not r.toxic]
    junk = [x.kept for x, r in judged if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) > 0
    assert sum(junk) <= 0.25 * len(junk)


# --- sharding in rounds ---------------------------------------------------------------


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_groups_get_their_shards_in_rounds_at_every_size(spark, sf):
    documents = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = sharding.rows_of(documents, 16)
    groups, total = sharding.groups_of(rows, 16), rows.count()
    plan, others, rounds = sharding.propagated(groups, total, 16)
    assert rounds >= 1
    placed = {bytes(t): {to for _, to in parts} for t, parts in plan}
    placed |= {bytes(r._text): {r._to} for r in others.collect()}
    held = {bytes(r._text): (r._n, r._held) for r in groups.collect()}
    assert placed.keys() == held.keys()
    assert all(len(to) == 1 for t, to in placed.items() if held[t][0] <= total // 16)
    loads = [sum(n for t, (n, _) in held.items() if s in placed[t]) for s in range(16)]
    assert max(loads) <= -(-total // 16)
    # most groups are where most of them was
    stayed = [held[t][1][next(iter(to))] == max(held[t][1]) for t, to in placed.items()]
    assert sum(stayed) >= 0.8 * len(stayed)
    assert sharding.cut_links(documents).count() == 0


def test_groups_that_find_their_shard_full_wish_anew(spark):
    sizes = [7] * 11 + [5] * 9 + [3] * 30 + [2] * 40
    docs = copies(spark, sizes, 3)
    rows = sharding.sharded(docs, shards=5).collect()
    found = [sum(r.shard == s for r in rows) for s in range(5)]
    assert len(rows) == sum(sizes) + 3 and max(found) - min(found) <= 1
    held = held_by(rows, docs)
    assert sum(len(set(held[f"copy {i}"])) > 1 for i in range(len(sizes))) <= 5
    _, _, rounds = sharding.propagated(sharding.groups_of(sharding.rows_of(docs, 5), 5), len(rows), 5)
    assert rounds > 2


# --- the pipeline ---------------------------------------------------------------------


def test_pipeline_stages_on_messy_rows(spark, messy, nothing):
    import corpus_pipeline
    from footfall.llm.tables import written

    sf = "/root/testdata/sf0.001"
    for given in (messy, nothing):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, sf), f"edge-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == given.columns, name
                rows = [r.asDict() for r in docs.collect()]
                assert all(r.asDict() in rows for r in out.collect()), name
                docs = out
        kept = [r.doc_id for r in docs.collect()]
        assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in out.collect())
    assert out.count() == 0 and out.columns[0] == "doc_id"
