"""The queries' contracts against plain versions, and hard inputs: long runs, hot ids, odd column names, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, decontamination, exact_dedup, language_id, lm_scoring, mixing, pii, simhash, token_output, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables as the queries read them."""
    r, base = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    words = {"en": "the house and with this there other people water".split(), "de": "das haus und mit dieser über menschen wasser straße".split()}
    rows = []
    for i in range(300):
        lang = "en" if i % 2 else "de"
        t = " ".join(r.choice(words[lang]) for _ in range(r.choice([0, 1, 2, 3, 40, 120])))
        if i % 7 == 0:
            t += r.choice([" a.b@c.de", " 10.0.0.1 x", " 4111 1111 1111 1111", " +49 (30) 1234567.", "\t1.2.3.4.5 @@ x@y"])
        rows.append((i, t if i % 31 else None, lang, "hot" if i % 3 == 0 else f"s{i % 4}", len(t)))
    rows += [(i, rows[5 + i % 3][1], "en", None, 1) for i in range(300, 320)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, rows[9][1]), (2, None), (3, "the house")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, rows


# --- personal data -------------------------------------------------------------------------------


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in digits(m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_of_random_texts():
    r = random.Random(1)
    for alphabet in ("a1.@-+ ", "0123456789 -.", "1.2 +()9-5", "ab@c.d%_+1"):
        for _ in range(2500):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
            assert [x[:3] for x in pii.spans_of(t) if x[0] in pii.BASE] == plain_spans(t), t


def test_personal_data_query(spark, folder):
    base, rows = folder
    got = {r["doc_id"]: r for r in pii.op2_pii(spark, base).collect()}
    for i, t, *_ in rows:
        want = plain_spans(t or "")
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()


@pytest.mark.parametrize("unit", ["1", "12.", "1 ", "a@", "+1", "@", "9-", "A1 ", "x.y@"])
def test_long_runs_take_linear_time(unit):
    started = time.time()
    pii.spans_of(unit * (1_000_000 // len(unit)))
    assert time.time() - started < 20


# --- SimHash -------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_and_components(spark, folder):
    base, rows = folder
    got = {r["doc_id"]: r for r in simhash.op10_simhash(spark, base).collect()}
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    for odd in ("A B\x0bC\x85d", "İ ÀÉ x", "one", "  ", "a\x1cb c d e", "tab\tnew\nline\rfeed\x0cend more"):
        assert simhash.fingerprint(odd.encode()) == plain_fingerprint(odd), odd
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            m = min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
            changed |= m < label[i]
            label[i] = min(m, label[i])
    assert {i: r["component_id"] for i, r in got.items()} == label


# --- URLs ----------------------------------------------------------------------------------------


def plain_url(u: str | None) -> tuple[str, str]:
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host: str, path: str) -> str | None:
    fits = [r for r, _ in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_urls_against_a_plain_version(spark):
    r = random.Random(2)
    parts = ["http://", "https://", "://", "example.org", "EXAMPLE.org", "a.b.com", "x.net", "/", "/es/", "/en/1", "/fr/", "/de/", "?", "#", "q=1&b=2;c", "%41", "-", "_", "ö", ""]
    urls = [None, "", "http://" + "a" * 200_000 + ".com/de/x", *("".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(1500))]
    urls += urls[:40]  # repeated rows
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["page_id"]: x for x in url_filter.judge(pages).collect()}
    verdicts = dict(url_filter.RULES)
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        rule = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdicts[rule] if rule else "block" if got[i]["block_score"] >= 0.5 else "allow")


def test_url_features_and_trees(spark):
    urls = [f"http://h{i % 9}.com/{'de' if i % 4 == 0 else 'fr'}/{'x' * (i % 13)}{i}?a={i}&b=Ü%2F" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.with_features(url_filter.with_parts(pages)).collect()
    for x in rows:
        u = x["url"]
        n = len(u)
        assert x["entropy"] == pytest.approx(-sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u)))
        assert x["digit_ratio"] == pytest.approx(sum(c in "0123456789" for c in u) / n) and x["url_length"] == n and x["parameters"] == 2
        assert x["depth"] == 2 and x["host_parts"] == 2 and x["https"] == 0
    # the trees' margin as an expression, against a walk over the nodes
    model, rates, share = url_filter.fit(pages)
    scored = url_filter.with_score(url_filter.with_features(url_filter.with_parts(pages)), model, rates, share).collect()

    def value(node, x):
        while node.feature is not None:
            node = node.left if x[node.feature] <= node.upto else node.right
        return node.value

    for x in scored:
        assert x["block_score"] == pytest.approx(1 / (1 + math.exp(-(model.base + sum(value(t, x) for t in model.trees)))))
    assert len(model.trees) == url_filter.TREES and share == pytest.approx(0.25)


# --- mixing --------------------------------------------------------------------------------------


def plain_draw(doc_id, text: str | None, rate: float) -> int:
    digest, parts = hashlib.md5((text or "").encode()).hexdigest(), max(1, math.ceil(rate / mixing.PART))
    mean, total = rate / parts, 0
    for k in range(1, parts + 1):
        u = int(hashlib.md5(":".join([str(mixing.SEED), "" if doc_id is None else str(doc_id), digest, *([str(k)] if k > 1 else [])]).encode()).hexdigest()[:13], 16) / 2**52
        p, cdf, n = math.exp(-mean), 0.0, 0
        while cdf + p <= u:
            cdf, n = cdf + p, n + 1
            p *= mean / n
        total += n
    return total


@pytest.mark.parametrize("epochs", [1.0, 40.0, 300.0])
def test_copies_against_a_plain_version(spark, epochs):
    docs = spark.createDataFrame([(i, f"t{i}", "a" if i < 20 else "b") for i in range(30)] + [(None, None, None)], "doc_id long, text string, source string")
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, None, epochs).collect()}
    got = {r["doc_id"]: (r["n"], r["top"]) for r in mixing.mix(docs, epochs=epochs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("top")).collect()}
    for i, t, s in [(i, f"t{i}", "a" if i < 20 else "b") for i in range(30)] + [(None, None, None)]:
        n = plain_draw(i, t, rate[s])
        assert got.get(i, (0, 0)) == (n, n)


def test_a_draw_of_any_mean(spark):
    for rate in (1e5, 1e7):
        parts = math.ceil(rate / mixing.PART)
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate / parts))).first()[0]
        one = spark.createDataFrame([(1, "x", parts, cdf)], "doc_id long, text string, parts long, cdf array<double>")
        started = time.time()
        n = one.select(mixing.drawn(F.col("parts"), F.col("cdf"), "doc_id", F.md5("text"), 17)).first()[0]
        assert abs(n - rate) < 6 * math.sqrt(rate)
        assert time.time() - started < 20


# --- language, tokens, toxicity, caches ----------------------------------------------------------


def small_model():
    words = {"en": language_id.Counter("the house and with this water people".split()), "de": language_id.Counter("das haus und mit dieser straße über".split())}
    return language_id.train(words, language_id.default_vocabulary(), 2)


def test_long_words_sum_all_segmentations():
    model = small_model()
    vocab = language_id.pieces(model.path)
    for word in ("h" * 200, "thehouseanddashaus" * 12, "日本語テキスト" * 30, "straße" * 40 + "\U0001f600" * 20, "x" * 31, "y" * 32):
        marked = language_id.MARK + word
        alpha = np.zeros((len(marked) + 1, 2), np.longdouble)
        alpha[0] = 1
        for i, j, p in language_id.lattice(marked, vocab, model.longest):
            alpha[j] += alpha[i] * model.prob[p]
        assert np.allclose(model.score_words([word])[0], np.log(alpha[-1]).astype(float), rtol=1e-9), word


def test_texts_in_runs_score_alike(monkeypatch):
    model, r = small_model(), random.Random(1)
    texts = [" ".join(r.choice(["the", "haus", "w" * 40, "über", "\t", "wasser"]) for _ in range(n)) for n in (0, 1, 30, 900)] + [None, "123", ""]
    whole = model.posteriors(texts)
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(language_id, "RUN", 7)
    language_id._memory.clear()
    for a, b in zip(whole, model.posteriors(texts)):
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b))


def test_language_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(language_id, "CACHE_WORDS", 500)
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 1000)
    model = small_model()
    language_id._memory.clear()
    for k in range(20):
        model.posteriors([" ".join(f"word{k}x{i}" for i in range(400))])
        assert all(len(m.row) <= 500 for m in language_id._memory.values())


def test_ties_go_to_the_first_language():
    same = language_id.Counter("one two three".split())
    model = language_id.train({"b": same, "a": same}, language_id.default_vocabulary(), 1)
    p = model.posterior("one two")
    assert model.languages == ["a", "b"] and int(p.argmax()) == 0 and p[0] == pytest.approx(0.5)


def test_another_operator_frees_the_memory():
    one, two = {"a": 1}, {"b": 2}
    common.hold(one)
    common.hold(one, two)
    assert one and two
    common.hold({})
    assert not one and not two


def test_encoders_of_other_kinds_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        mine, plain = token_output.WordEncoder(path), Tokenizer.from_file(path)
        for t in ("The  Quick\nBROWN fox, über!", "", "a" * 3000 + " b", "x \t y\r\n z", "word " * 200 + "Ünd 12.5%"):
            assert np.frombuffer(mine.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert mine.whole is False and not any(len(c) > token_output.CACHE_LONGEST for c in mine.chunks[0])


def test_token_query(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    base, rows = folder
    plain, start = Tokenizer.from_file(token_output.default_tokenizer()), 0
    got = {r["doc_id"]: r for r in token_output.op4_token_output(spark, base).collect()}
    for i, t, *_ in sorted(rows):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, token_output.END_ID]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    # an id that repeats very often is dealt to several shards
    hot = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(None, f"null {i}") for i in range(200)], "doc_id long, text string")
    manifest = token_output.write_tokens(hot, f"file://{tmp_path}/hot", shard_rows=100)
    assert len(manifest) >= 5 and sum(m["n_docs"] for m in manifest) == 700 and max(m["n_docs"] for m in manifest) < 350
    ids = [r["doc_id"] for r in token_output.read_tokens(spark, f"file://{tmp_path}/hot", manifest).orderBy("start").collect()]
    assert ids == [None] * 200 + [1] * 500


def test_window_savings_against_the_library():
    import zstandard

    rows = [(f"plain words {i} of a text " * 9, 0, i % 3 > 0) for i in range(60)] + [(f"plain scumbag words {i} worthless scumbag " * 5, 1, i % 3 > 0) for i in range(30)]
    model, t = toxicity.train(iter(rows)), "some worthless scumbag in a plain text " * 6
    length = lambda d, w: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(w))
    want = [length(model.ordinary, w) - length(model.toxic + model.ordinary, w) for w in toxicity.windows(t)]
    assert model.savings(t).tolist() == want and b"".join(w[: toxicity.STRIDE] for w in toxicity.windows(t)).startswith(t.encode()[:200])
    assert model.score(t) == model.score(t) > 0.5 > model.score("plain words of a text " * 9) and 0 <= model.score(None) == model.score("") <= 1


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "the house", "en", 7)], "doc_id long, text string, lang string, `a``b.c` long")
    model = small_model()
    assert language_id.predict(docs, model).columns == ["doc_id", "lang", "a`b.c", "lang_pred", "score"] and language_id.keep_languages(docs, model).columns == docs.columns
    assert toxicity.score(docs, toxicity.Model(b"", b"")).collect()[0]["a`b.c"] == 7
    ids = lm_scoring.encoded(docs)
    assert lm_scoring.score(ids, lm_scoring.fit(ids, docs.select("doc_id"))).collect()[0]["a`b.c"] == 7
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_last_stages_against_a_plain_version(spark, folder):
    """Mixing draws as the plain version does, and the token stage returns one row for each copy with its ids' checksum."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    base, rows = folder
    docs = spark.createDataFrame(rows[:60], DOCS)
    mixed = corpus_pipeline.mix(spark, docs, base)
    assert mixed.columns == docs.columns
    sources = [s for _, _, _, s, _ in rows[:60]]
    copies = {i: plain_draw(i, t, len(rows[:60]) / len(set(sources)) / sources.count(s)) for i, t, _, s, _ in rows[:60]}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}
    plain = Tokenizer.from_file(token_output.default_tokenizer())
    out = corpus_pipeline.tokens(spark, spark.createDataFrame(mixed.collect(), DOCS), base).collect()
    crc = {i: zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, *_ in rows[:60]}
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in out) == sorted((i, crc[i]) for i, n in copies.items() for _ in range(n))


def test_stages_remove_what_they_leave(spark, folder, tmp_path):
    import os

    import corpus_pipeline

    base, _ = folder
    shared = common.shared_dir(spark).removeprefix("file://")
    corpus_pipeline.run(spark, base).count()
    left = {x.rsplit("-", 1)[0].rsplit("/", 1)[-1] for x in os.listdir(shared)}
    before = set(os.listdir(shared))
    corpus_pipeline.run(spark, base).count()
    new = {re.sub("-[0-9a-f]{32}$", "", x) for x in set(os.listdir(shared)) - before}
    assert new <= {"pipeline", "tokens"} and left


def test_contamination_hashes_are_bounded(monkeypatch):
    monkeypatch.setattr(decontamination, "CACHE_WORDS", 10)
    words = [f"w{i}" for i in range(100)] * 2
    assert decontamination.word_hashes(words).tolist() == [decontamination._word_hash(w) for w in words] and len(decontamination._hashes) <= 20


def test_a_snapshot_serves_several_batches(spark, folder, tmp_path):
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    old, place = docs.where("doc_id < 100"), f"file://{tmp_path}/v1"
    exact_dedup.write_snapshot(old, place)
    for batch in (docs.where("doc_id between 100 and 200"), docs.where("doc_id > 200"), docs.limit(0)):
        opened = exact_dedup.dedup_against(exact_dedup.open_snapshot(old, place), batch)
        built = exact_dedup.dedup_against(old, batch)
        assert sorted(map(tuple, opened.collect())) == sorted(map(tuple, built.collect()))


def test_encoder_of_batches_matches_library(monkeypatch):
    """Nulls, empty and very long texts, odd white space, special tokens and random strings; with small caches and pieces too."""
    from tokenizers import Tokenizer

    path, rnd = token_output.default_tokenizer(), random.Random(5)
    plain = Tokenizer.from_file(path)
    letters = "aB éß'..,!\t\n\v\f\r\x1c\x85\xa0́Σς中😀0 9%-&<|endoftext|>"
    texts = [None, "", " ", "\n\n", "a" * 50_000, "ab " * 50_000, "Ünïcödé!!! x", "İstanbul ΣΑΣ ΑΣ.", "é ́a", "<|endoftext|> a", "...", "word,.word!", "don't WE'LL"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for cache, at_once in ((300_000, 4 << 20), (50, 1000)):
        monkeypatch.setattr(token_output, "CACHE_WORDS", cache)
        monkeypatch.setattr(token_output, "AT_ONCE", at_once)
        mine, column = token_output.WordEncoder(path), pa.array(texts, pa.string())
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_all(column)] == want
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_all(column.slice(7, 500))] == want[7:507]
        assert list(mine.encode_all(column.slice(0, 0))) == []
