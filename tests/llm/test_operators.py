"""The operators on Spark: brute force on small tables, and the odd cases of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, chat, decontam, linededup, lmscore, media, neardup, sharding, toxicity, warc
from quern.llm.queries import QUERIES, word_bpe_path

DOCS = "doc_id bigint, text string, class int, key string, id string, at string"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "k", "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    base = words(rng, 60)
    return frame(spark, [(1, None), (2, ""), (3, " \n\t"), (4, base), (4, base), (5, base), (None, base), (6, "short one"), (7, "short one"), (8, words(rng, 30_000)), (9, "é ü 中 \U0001f600"), (10, base + " more")])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_sharding(odd, empty):
    got = sharding.byte_shards(odd, "doc_id", "text", 5, blocks=3).collect()
    rows = odd.select("doc_id", "text").collect()
    assert sorted((r["size"], r["text_crc32"] or 0) for r in got) == sorted((len((r["text"] or "").encode()) + 16, zlib.crc32(r["text"].encode()) if r["text"] is not None else 0) for r in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.byte_shards(empty, "doc_id", "text", 5).count() == 0


def test_shards_are_even_and_contiguous(spark):
    rng = random.Random(2)
    df = frame(spark, [(i, "x" * rng.randrange(200)) for i in range(2000)])
    got = sharding.byte_shards(df, "doc_id", "text", 40, blocks=7).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * 216
    assert [r["shard"] for r in sorted(got, key=lambda r: r["doc_id"])] == sorted(r["shard"] for r in got)


def test_media(odd, empty):
    def run(df):
        return media.wav_features(media.sniff_media(media.store_wav(df, "doc_id", "text"), "doc_id"), "doc_id")

    for r, text in zip(run(odd).collect(), odd.collect(), strict=True):
        raw = (text["text"] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_type"] == "audio/wav" and r["corrected"]
    assert run(empty).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "<|im_end|>b"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "assistant", "n"), (1, 1, "assistant", "<|im_end|>b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("parts", F.expr(f"array(cast(named_struct('type','text','text',text,'ref',null,'width',null,'height',null,'millis',null,'pages',null) as {chat.PART}))"))
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    want = "user\na\n" + "assistant\n<|im_end|>b\n" * 2 + "\n\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[1]["n_turns"] == 4
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (22, hashlib.sha256(b"<|im_end|>b" * 2).hexdigest())
    assert got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    assert chat.read_chat(chat.format_chat(df.limit(0))).count() == 0


def test_bpe(odd, empty):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(word_bpe_path())
    for r, text in zip(bpe.encode_digest(odd, "doc_id", "text", word_bpe_path(), with_ids=True).collect(), odd.collect(), strict=True):
        ids = other.encode(text["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digest(empty, "doc_id", "text", word_bpe_path()).count() == 0


def test_warc(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (5, "u", "same"), (5, "u", "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(warc.write_pages(df)).collect()), key=str)
    assert got == sorted([(1, "revisit", 5, 4), (2, "revisit", 5, 4), (5, "response", None, 4), (5, "revisit", 5, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (0, "revisit", 5, 4), (0, "response", None, 5)], key=str)
    assert warc.read_archives(warc.write_pages(df.limit(0))).count() == 0


def test_foreign_archives_from_files(spark, tmp_path):
    def record(kind, block, *more, content="application/http;msgtype=response"):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"

    records = [
        record("warcinfo", b"software: x\r\n", content="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", content="application/http;msgtype=request"),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nsome\r\n3;x=1\r\n it\r\n0\r\n\r\n", "WARC-Target-URI: <http://a/%20b>", f"WARC-Payload-Digest: sha1:{warc.digest_of(b'some it')}"),
        record("response", b"HTTP/1.0 200 OK\r\n\r\nno length", "X-Note: one\r\n\ttwo \xe9"),
        record("metadata", b"", content="text/plain"),
        record("revisit", b"", "WARC-Payload-Digest: sha1:ABC", content="message/http"),
    ]
    for i in range(2):
        (tmp_path / f"{i}.warc.zst").write_bytes(warc.pack(records))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = sorted((r["record_type"], r["payload_bytes"], r["payload_digest"], r["url"]) for r in warc.read_archives(files.where("path like '%/0.warc.zst'")).collect() if r["record_type"] != "revisit")
    want = [("warcinfo", b"software: x\r\n", ""), ("request", b"GET / HTTP/1.1\r\n\r\n", ""), ("response", b"some it", "http://a/%20b"), ("response", b"no length", ""), ("metadata", b"", "")]
    assert got == sorted((k, len(b), warc.digest_of(b), u) for k, b, u in want)
    both = warc.read_archives(files)
    assert both.count() == 2 * len(records) and [(r["payload_bytes"], r["payload_digest"]) for r in both.where("record_type = 'revisit'").collect()] == [(None, "ABC")] * 2
    for bad in (b"zz\r\n", b"4\r\nso", b""):
        with pytest.raises(warc.WarcError):
            warc.unchunked(bad)


def components_by_force(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and root[a] != root[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    low = min(root[a], root[b])
                    root = {i: low if r in (root[a], root[b]) else r for i, r in root.items()}
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(7)
    rows, i = [], 0
    for _ in range(12):
        base = words(rng, rng.randrange(30, 120)).split()
        for _ in range(rng.randrange(1, 10)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append((i, " ".join(own)))
            i += 1
    passage = words(rng, 60)
    for _ in range(30):  # texts that share a passage but are no copies
        rows.append((i, words(rng, 15) + " " + passage + " " + words(rng, 15)))
        i += 1
    rows += [(i + 1, ""), (i + 2, None), (i + 3, "A b"), (i + 4, "a B"), (i + 5, "  ")]
    want = components_by_force(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want and len({r for _, r in want.values()}) < len(rows)


def test_near_duplicates_odd(odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r["component_id"] for r in got if r["doc_id"] in (4, 5, 10)} == {4}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1, 2, 3}
    assert neardup.near_duplicates(empty).count() == 0


def test_decontamination(spark, odd, empty):
    rng = random.Random(9)
    items = [(k, words(rng, 25)) for k in range(20)] + [(90, "too few tokens"), (91, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows, want = [], {}
    for i in range(120):
        own, text = i % 20, words(rng, 40)
        passage = items[own][1].split()
        if i % 3 == 0:
            if i % 2:
                for k in (4, 13, 21):  # substitutions: one in each stretch
                    passage[k] = "zzz"
            text = f"{text} {' '.join(passage).upper()}, {words(rng, 10)}"
            want[i] = [own]
        elif i % 3 == 1:
            text += " " + " ".join(passage[:6])  # too short an overlap
        rows.append((i, text))
    got = decontam.with_contamination(frame(spark, rows), bench).collect()
    assert {r["doc_id"]: list(r["items"]) for r in got if r["contaminated"]} == want and len(got) == 120
    assert not any(r["contaminated"] for r in decontam.with_contamination(odd, bench).collect())
    # Brute force: every item beside every place of every text.
    short = [(100, "alpha beta gamma delta eps zeta eta theta iota kappa"), (101, "one two three four five six"), (102, "seven eight nine ten")]
    own = {k: t.split() for k, t in short}
    texts = []
    for i in range(60):
        k, bad = short[i % 3][0], rng.sample(range(len(own[short[i % 3][0]])), i // 3 % 4 if i % 3 < 2 else 0)
        texts.append((i, " ".join([*words(rng, i % 4).split(), *("zzz" if j in bad else w for j, w in enumerate(own[k])), *words(rng, 3).split()])))
    texts += [(None, texts[0][1]), (-1, texts[0][1]), (None, "clean of all")]

    def brute(t):
        t, found = t.split(), []
        for k, item in own.items():
            tier = next((x for x in decontam.TIERS if len(item) >= x[0]), None)
            if tier and any(sum(0 <= s + j < len(t) and t[s + j] == w for j, w in enumerate(item)) >= len(item) - tier[1] for s in range(-len(item), len(t))):
                found.append(k)
        return found

    clash = spark.createDataFrame([(i, t, "a", "b") for i, t in texts], "doc_id bigint, text string, items string, th string")
    got = decontam.with_contamination(clash, spark.createDataFrame(short, "item_id bigint, text string"))
    assert got.columns == ["doc_id", "text", "th", "contaminated", "items", "overlap"]
    assert sorted((str(r["doc_id"]), r["text"], list(r["items"])) for r in got.collect()) == sorted((str(i), t, brute(t)) for i, t in texts)
    assert decontam.with_contamination(empty, bench).count() == 0 and decontam.with_contamination(odd, bench.limit(0)).count() == odd.count()


def sentences(rng, n):
    return " ".join(words(rng, rng.randrange(4, 12)).capitalize() + "." for _ in range(n))


def test_line_dedup(spark, odd, empty):
    rng = random.Random(11)
    passage = sentences(rng, 9)
    rows = [(i, sentences(rng, 12) + ("\n" + passage + " " if i % 2 else " ") + sentences(rng, 3)) for i in range(24)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    for i, text in rows:
        if i % 2 and i > 1:
            assert passage not in got[i]["text"] and got[i]["removed_words"] > 30
            left = set(re.findall(r"\w+", got[i]["text"].lower()))
            assert set(re.findall(r"\w+", text.replace(passage, "").lower())) <= left
        else:
            assert got[i]["text"] == text and got[i]["removed_words"] == 0
    done = linededup.dedup_lines(odd).collect()
    assert len(done) == odd.count() and done[0].__fields__[:6] == odd.columns
    assert linededup.dedup_lines(empty).count() == 0
    copies = frame(spark, [(1, passage), (2, passage), (3, sentences(rng, 4))])
    assert [r["text"] for r in sorted(linededup.dedup_lines(copies).collect(), key=lambda r: r["doc_id"])][:2] == [passage, ""]
    assert sum(r["removed_words"] for r in linededup.dedup_lines(copies, spare_copies=True).collect()) == 0


def test_short_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(29)
    passages = [". ".join(words(rng, -(-40 // n)).capitalize() for _ in range(n)) + "." for n in range(1, 9) for _ in range(5)]
    rows, own = [], {}
    for k, passage in enumerate(passages):
        for i in range(4):
            # Two passages adjoin in the last text of every other passage.
            shared = [passage, *([passages[k - 1]] if i == 3 and k % 2 else [])]
            own[4 * k + i] = (sentences(rng, rng.randrange(5)), sentences(rng, rng.randrange(1, 5)))
            rows.append((4 * k + i, " ".join([own[4 * k + i][0], *shared, own[4 * k + i][1]]).strip()))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    for i, text in rows:
        assert got[i]["text"].split() == (" ".join(own[i]).split() if i % 4 else text.split()), i


def test_only_near_duplicates_are_spared(spark):
    rng = random.Random(31)
    long, short = sentences(rng, 40), sentences(rng, 10)
    near = long.rsplit(" ", 3)[0] + " " + words(rng, 3)
    rows = [(1, long), (2, near), (3, short + " " + sentences(rng, 20)), (4, short + " " + sentences(rng, 3))]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, rows), spare_copies=True).collect()}
    assert got[2]["text"] == near and short not in got[4]["text"]
    assert got[4]["removed_words"] == len(short.split())


def test_toxicity(spark, odd, empty):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = words(rng, 30).split()
        for _ in range(3 * toxic):
            text.insert(rng.randrange(30), rng.choice(["blockhead", "nitwit", "dunce"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame(spark, rows), toxicity.training_labels(lab))
    assert set(model.weights) == {"blockhead", "nitwit", "dunce"}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame(spark, rows), model).collect()}
    assert got == dict(labels)
    assert {r["predicted"] for r in toxicity.score(odd, model).collect()} == {0}
    none = toxicity.fit(empty, lab)
    assert toxicity.score(empty, none).count() == 0 and 0 <= none.score("x") < 0.5


def test_language_model(spark, odd, empty):
    rng = random.Random(17)
    tongues = [[words(rng, 1, a) for _ in range(60)] for a in ("abcd", "efgh", "ijkl")]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randrange(20, 80)))) for i in range(900)]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*t.split(), "\n"])
    n, v = sum(c.values()), len(c)
    total = Counter()
    texts = dict(rows)
    for r in lmscore.scores(frame(spark, rows), held).collect():
        own = [*texts[r["doc_id"]].split(), "\n"]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        total["base"] += r["base_score"] * r["held_out"]
        total["own"] += r["score"] * r["held_out"]
    assert total["own"] > total["base"]
    assert lmscore.scores(odd, held).count() == odd.count() and lmscore.scores(empty, held).count() == 0


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(19)
    tongue = [words(rng, 1) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(tongue) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    df, held = frame(spark, rows), F.col("doc_id") % 5 == 1
    one, four = ({r["doc_id"]: r["score"] for r in lmscore.scores(d, held).collect()} for d in (df.coalesce(1), df.repartition(4, "text")))
    assert one == pytest.approx(four, rel=1e-5)


def test_every_training_text_reaches_the_weights(spark):
    texts = frame(spark, [(1, "one two three two one " * 20)]).select("doc_id", "text")
    vocab = lmscore.vocabulary(lmscore.token_counts(texts.select("text")))
    untrained = vocab.model().flat()
    coded = lmscore.coded(texts.withColumn("held_out", F.lit(False)), vocab)
    for at in (0, 1, 2, 7, 256, 513, -1):
        assert (lmscore.train(coded.withColumn("at", F.lit(at).cast("long")), vocab).flat() != untrained).any(), at


def test_weights_of_many_groups_are_averaged_by_symbols(spark):
    import numpy as np

    rows = [(g, g % 7 + 1, ((g % 7 + 1) * np.arange(3.0) * g).tobytes()) for g in range(100)]
    parts = spark.createDataFrame(rows, "group bigint, seen bigint, sums binary").repartition(5)
    weights = np.array([g % 7 + 1 for g in range(100)])
    assert lmscore._mean(parts, 100) == pytest.approx(np.average([np.arange(3.0) * g for g in range(100)], axis=0, weights=weights))
    assert lmscore._mean(parts.limit(0), 1) is None


def test_gru_gradients():
    import numpy as np

    from quern.llm.gru import Gru, Lanes

    rng = np.random.default_rng(3)
    g = Gru(8, 11, 4, np.arange(1.0, 12.0), hidden=5, dtype=np.float64)
    g.own += rng.normal(0, 0.3, g.own.shape)
    texts = [rng.integers(0, 11, n).astype(np.int16) for n in (7, 3, 9, 1, 12)]
    window = Lanes(texts, 3, [2] * 5).window(0, 16)[:4]
    found, rest = np.zeros_like(g.own), np.zeros_like(g.own)

    def loss(into):
        return -g.window(g.views(g.own), *window, np.zeros((5, 3)), g.views(into))[0]

    assert loss(found) == pytest.approx(-g.log_likelihood(texts, 2).sum(), rel=1e-6)
    for i in rng.choice(len(g.own), 200, replace=False):
        kept, ends = g.own[i], []
        for e in (1e-6, -1e-6):
            g.own[i] = kept + e
            ends.append(loss(rest))
        g.own[i] = kept
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(found[i], abs=1e-6), i


def test_gru_carries_its_state_and_learns():
    import numpy as np

    from quern.llm.gru import Gru

    rng = np.random.default_rng(5)
    g = Gru(8, 10, 4, np.ones(10))
    docs = [rng.integers(0, 10, n).astype(np.int16) for n in (1, 5, 700, 17)]
    assert g.log_likelihood(docs, 0) == pytest.approx([g.log_likelihood([d], 0)[0] for d in docs], rel=1e-4)
    steady = [np.tile([1, 5], 400).astype(np.int16) for _ in range(64)]
    before = g.log_likelihood(steady[:1], 0)[0]
    assert g.train(iter([steady] * 6), 0) == 6 * 64 * 800
    assert g.log_likelihood(steady[:1], 0)[0] > before / 3


def test_stages_keep_rows_without_ids_and_clashing_columns(spark, sf):
    import corpus_pipeline

    rng = random.Random(37)
    text, other = words(rng, 60), words(rng, 60)
    rows = [(-1, text), (None, text), (3, other), (3, other), (None, None), (4, ""), (None, words(rng, 50))]
    docs = spark.createDataFrame([(i, t, 1, 2.0, "i", "r") for i, t in rows], "doc_id bigint, text string, predicted int, score double, items string, removed string")
    want = sorted(((-1, text), (3, other), (None, None), (4, ""), rows[6]), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert got == (want if name == "minhash_near_dedup" else sorted(rows, key=str)), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, sf, name):
    tables = {"op3_chat": "conversations", "op9_warc": "pages"}
    df = QUERIES[name](spark, sf)
    keys = {"conversations": "conv_id", "pages": "page_id"}
    own = spark.read.parquet(f"{sf}/{tables.get(name, 'documents')}.parquet")
    key = keys.get(tables.get(name), "doc_id")
    assert df.count() == own.select(key).distinct().count() + (name == "op3_chat")


def test_pipeline(spark, sf):
    import corpus_pipeline

    from quern.llm.common import cut

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= kept and len(ids) == len(set(ids))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        kept = set(ids)
    assert kept == {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
