"""Tokenization, mixing and language labels: exact round trips, realised shares, held-out accuracy."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainforge.llm import byte_bpe, languages, mixing

VOCABULARY = f"{byte_bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def both():
    import regex
    import tiktoken

    tokens = byte_bpe.read_ranks(VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=byte_bpe.PIECES, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    pieces = regex.compile(byte_bpe.PIECES)
    encoder = byte_bpe.Encoder(tokens)
    return lambda s: [i for p in pieces.findall(s) for i in encoder[p]], reference.encode_ordinary, tokens


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_exactly(both, text):
    ours, theirs, tokens = both
    ids = ours(text)
    assert ids == theirs(text)
    assert b"".join(tokens[i] for i in ids).decode() == text


@needs_vocabulary
def test_repetitive_texts(both):
    ours, theirs, _ = both
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "th", "er", "ing", " ", "=", "0", "é", "漢"]) for _ in range(rng.randrange(60)))
        assert ours(text) == theirs(text)
    for text in ("a" * 5000, "=-" * 3000, " " * 5000, "é" * 3000, "9" * 4000):
        assert ours(text) == theirs(text)


def test_a_made_up_vocabulary_against_a_merge_loop():
    rng = random.Random(2)
    for _ in range(20):
        tokens = [bytes([b]) for b in b"abc"]
        while len(tokens) < 40:
            t = rng.choice(tokens) + rng.choice(tokens)
            if t not in tokens:
                tokens.append(t)
        rank = {t: i for i, t in enumerate(tokens)}
        encoder = byte_bpe.Encoder(tokens)
        whole = [i for i, t in enumerate(tokens) if len(t) > 1 and encoder.halves[i] is None]
        if whole:  # a token that its own merges don't reach isn't part of a trained vocabulary
            continue
        for _ in range(200):
            s = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
            parts = [c.encode() for c in s]
            if s.encode() in rank:
                parts = [s.encode()]
            while True:
                best = min((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank) if any(a + b in rank for a, b in zip(parts, parts[1:])) else None
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert list(encoder.encode(s)) == [rank[p] for p in parts]


@needs_vocabulary
def test_encode_texts_of_all_kinds(spark):
    import tiktoken

    tokens = byte_bpe.read_ranks(VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=byte_bpe.PIECES, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = [None, "", " ", "<|endoftext|> is text", "Hello wörld\r\n\t x", "a\u0000b", "xyz " * 50_000, "dup", "dup"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode_texts(df, F.col("doc_id"), F.col("text")).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in byte_bpe.encode_texts(df, F.col("doc_id"), F.col("text"), counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert byte_bpe.encode_texts(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_mix_reaches_its_shares(spark):
    rng = random.Random(3)
    n = {"big": 6000, "mid": 1500, "small": 300, "untargeted": 500}
    rows = [(i, s, rng.choice([0, 5, 50, 400])) for i, s in enumerate(s for s, k in n.items() for _ in range(k))] + [(None, "big", 7), (3, None, 9)]
    targets = [("big", 4.0, 1), ("mid", 3.0, 3), ("small", 1.0, 5), ("absent", 2.0, 2), ("nothing", 0.0, 3), ("unknown", None, 3), (None, 1.0, 1)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    listed = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    caps = {s: c for s, _, c in targets}
    for total in (None, 200_000):
        selection, shares = mixing.mix(sizes, listed, total)
        got = {r["source"]: r for r in shares.collect()}
        assert set(got) == {"big", "mid", "small", "absent", "nothing", "unknown"}
        for s in ("big", "mid", "small"):
            assert abs(got[s]["actual_share"] - got[s]["target_share"]) < 0.01
            assert got[s]["most_repeats"] <= caps[s]
        assert abs(sum(got[s]["target_share"] for s in ("big", "mid", "small")) - 1) < 1e-9
        assert got["absent"]["actual_share"] == 0 and got["absent"]["target_share"] is None
        picked = selection.collect()
        assert all(r["n_tokens"] > 0 and 1 <= r["copy_no"] <= caps[r["source"]] for r in picked)
        assert sum(r["n_tokens"] for r in picked) == sum(r["n_tokens"] for r in got.values())
        if total:
            assert abs(sum(r["n_tokens"] for r in picked) / total - 1) < 0.01
        assert [tuple(r) for r in picked] == [tuple(r) for r in mixing.mix(sizes.repartition(3), listed, total)[0].collect()]
    selection, shares = mixing.mix(sizes.limit(0), listed)
    assert selection.count() == 0 and shares.count() == 6


def test_poisson_steps():
    assert mixing._cdf(0.0, 3) == (0, []) and mixing._cdf(float("inf"), 2) == (2, [])
    zeros, steps = mixing._cdf(1.0, 3)
    assert zeros == 0 and abs(steps[2] - 0.9196986) < 1e-6
    assert mixing._cdf(5000.0, 100) == (100, []) and len(mixing._cdf(1e-6, 1000)[1]) < 10


def test_realised_tokens_are_counted_like_draws():
    rng = np.random.default_rng(5)
    u, tokens = rng.random(500), rng.integers(1, 90, 500)
    for mean, cap in ((0.0, 3), (0.02, 1), (0.7, 4), (9.0, 20), (900.0, 1000), (float("inf"), 6)):
        zeros, steps = mixing._cdf(mean, cap)
        n = zeros + (np.array(steps)[None, :] <= u[:, None]).sum(1)
        assert n.max() <= cap and mixing.realised(u, tokens, [mean], cap).ravel().tolist() == [(n * tokens).sum(), n.sum()]


def test_means_at_every_rate(spark):
    n, tokens = 2_000_000, 7
    drawn = spark.range(n).select(F.lit("s").alias("source"), (F.shiftrightunsigned(F.xxhash64("id"), 11) * F.lit(2.0**-53)).alias("u"), F.lit(tokens).alias("n_tokens"))
    for rate, cap in ((1e-6, 1), (1e-5, 3), (0.02, 1), (0.999, 1), (3.0, 5), (800.0, 2000)):
        wanted = rate * n * tokens
        mean = mixing.fit_means(drawn, {"s": (wanted, cap, n * tokens)})["s"]
        zeros, steps = mixing._cdf(mean, cap)
        got = drawn.where(F.col("u") >= (min(steps) if steps and not zeros else 0.0)).select("u").toPandas()["u"].to_numpy()
        realised = mixing.realised(got, np.full(len(got), tokens), [mean], cap)[0, 0]
        assert abs(realised - wanted) <= max(tokens, 2e-4 * wanted), (rate, realised / wanted)
    assert mixing.fit_means(drawn, {"s": (2 * n * tokens, 2, n * tokens)})["s"] == float("inf")


SENTENCES = {
    "en": ["There is no reason to keep the old table", "We should check the second plot again", "This is what happens when the model is changed", "Please do not edit the list of donors"],
    "de": ["Es gibt keinen Grund die alte Tabelle zu behalten", "Wir sollten das zweite Bild noch einmal prüfen", "Das passiert wenn man das Modell ändert", "Bitte die Liste der Spender nicht bearbeiten"],
    "fr": ["Il n'y a aucune raison de garder l'ancien tableau", "Il faut encore vérifier le deuxième graphique", "Voici ce qui arrive quand on change le modèle", "Merci de ne pas modifier la liste des donneurs"],
    "ru": ["Нет причин хранить старую таблицу", "Нужно ещё раз проверить второй график", "Вот что будет если изменить модель", "Не надо менять список доноров"],
}


def _notebook(cells):
    return "﻿" + "\r\n".join(f"#%% {i} text\n{c}\n#%% {i + 100} code [ ]\nprint(x)\n#%% {i + 100} output\n#%% x" for i, c in enumerate(cells, 1))


def test_languages_on_held_out_documents(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(240):
        code = rng.choice(list(SENTENCES))
        cells = [". ".join(rng.sample(SENTENCES[code], 2)) for _ in range(5)]
        truth[i] = (code, None)
        if rng.random() < 0.2:
            other = rng.choice([c for c in SENTENCES if c != code])
            cells[3] = ". ".join(SENTENCES[other][:2])
            truth[i] = (code, other)
        label = rng.choice([code, code.upper(), {"en": "English", "de": "deutsch", "fr": "fr_FR.UTF-8", "ru": " Русский "}[code]])
        if rng.random() < 0.15:
            label = rng.choice(["xx", None, "", rng.choice(list(SENTENCES))])
        rows.append((i, _notebook(cells), label))
    rows += [(900, None, "en"), (901, "", "en"), (902, "#%% 1 code [1]\nprint(1)", None), (903, "#%% 1 text\n12 $$x$$ `a`", "de"), (904, _notebook(["Wir sollten das prüfen. " * 20_000]), None), (None, _notebook(SENTENCES["fr"]), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("main", F.lit(1))
    got = languages.languages(df, F.col("doc_id"), F.col("text"), F.col("lang"), per_language=15).collect()
    docs = {r["doc_id"]: r for r in got if r["cell_no"] == 0}
    assert len(docs) == len(rows)
    assert all(docs[i]["lang"] == code and 0 < docs[i]["confidence"] <= 1 for i, (code, _) in truth.items())
    odd = {(r["doc_id"], r["cell_no"], r["lang"]) for r in got if r["cell_no"] > 0 and r["lang"] != r["main"]}
    assert odd == {(i, 4, other) for i, (_, other) in truth.items() if other}
    assert [docs[i]["lang"] for i in (900, 901, 902, 903, 904, None)] == [None, None, None, None, "de", "fr"]
    assert docs[900]["label"] == "en" and docs[902]["confidence"] == 0
    nothing = languages.languages(df.withColumn("lang", F.lit(None).cast("string")), F.col("doc_id"), F.col("text"), F.col("lang"))
    assert {r["lang"] for r in nothing.collect()} == {None}
    assert languages.languages(df.limit(0), F.col("doc_id"), F.col("text"), F.col("lang")).count() == 0


def test_cells_and_labels(spark):
    text = "#%% 1 text\nA\r\n#%% 2 code [3]\n# x\n#%% 2 output\n #%% 3 text\n#%% 3 text\nB"
    assert [(n, t.strip()) for n, t in languages.text_cells(text)] == [(1, "A"), (3, "B")]
    df = spark.createDataFrame([("pt-BR", "pt"), ("ENGLISH", "en"), (" français ", "fr"), ("ru_RU.UTF-8", "ru"), ("??", None), ("", None), (None, None), ("english text", "en")], "l string, w string")
    assert all(r["g"] == r["w"] for r in df.withColumn("g", languages.label_language(F.col("l"))).collect())
