import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from episodica.llm import bpe_codec, decontaminate, flac, jaccard_join, langid, media, meeting, pii, quality, runtime, spans, suffix_dedup, token_counts, token_output  # noqa: E402

SCHEMA = "doc_id long, text string, n_tokens string, score string"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = sentence(200)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace(BASE.split()[7], "changed", 1)), (4, None), (5, ""), (6, "  \n "), (7, "one two"), (8, "One TWO"),
    (9, sentence(60) + " " + " ".join(BASE.split()[20:60])), (None, BASE), (2, BASE), (10, sentence(4000)), (11, "é" * 90), (12, "x" * 400), (13, "y" * 30 + BASE[:120]),
    (14, "mail a.b@c.example.org, ip 10.0.0.255 and 1.2.3.999, card 4111 1111 1111 1111, call +49 (30) 1234-5678, iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, no 123-45-6780x9"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in ROWS], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_decontamination(spark, docs):
    items = [(1, " ".join(BASE.split()[30:50])), (10, "one two"), (2, None), (3, "!!"), (2, " ".join(BASE.split()[30:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in ROWS:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(13, len(x))
            for s in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        want.append((i, len(w), len(hit), sorted(found)))
    pick = lambda df: rows(df.select("doc_id", "n_words", "n_hit", "item_ids"))
    assert pick(decontaminate.contamination(docs, bench)) == sorted(want, key=str)
    assert pick(decontaminate.contamination(docs, bench, block_bytes=100)) == sorted(want, key=str)
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_queries_of_contracts(spark, tmp_path):
    """op2, op3, op4 and op10 as registered, against the libraries, text by text."""
    from episodica.llm import queries

    data = [(i, t, "en", "s", len(t or "")) for i, t in ROWS if i is not None]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    coder = bpe_codec.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = lambda t: coder.encode_ordinary(t or "")
    want = sorted((i, len(ids(t)), hashlib.sha256(struct.pack(f"<{len(ids(t))}I", *ids(t))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in data)
    assert rows(queries.op2_bpe_codec(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(want, key=str)
    fast = token_counts.tokenizer(P.path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), len(fast.encode(t or "", add_special_tokens=False))) for i, t, *_ in data]
    assert rows(queries.op3_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens")) == sorted(want, key=str)
    want = [(i, len((t or "").encode()), len(media.payload(t)), hashlib.sha256(media.payload(t)).hexdigest(), zlib.crc32(media.payload(t)[-16:])) for i, t, *_ in data]
    assert rows(queries.op4_media_columns(spark, str(tmp_path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == sorted(want, key=str)


def test_bpe_round_trip(docs):
    out = bpe_codec.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((bytes(r.decoded) for r in out)) == sorted((t or "").encode() for _, t in ROWS)
    coder = bpe_codec.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in ("a  b\n\n c1d2 x", sentence(300), "ab" * 500, "don't 12ab"):
        assert bpe_codec.encode(text, coder, 20) == coder.encode_ordinary(text)


def test_token_counts(docs):
    path = P.path("byte_bpe_50k.json")
    coder = token_counts.tokenizer(path)
    out = token_counts.count_tokens(docs, path, 512).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len(coder.encode(t or "", add_special_tokens=False))) for i, t in ROWS)
    rng = random.Random(2)
    long = ["x" * 30_000, sentence(6000), "é" * 20_000 + " " + sentence(4000), ("word\n" * 9000), "ab  \n " * 5000]
    df = docs.sparkSession.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path, 512).collect()} == {k: len(coder.encode(t, add_special_tokens=False)) for k, t in enumerate(long)}
    assert token_counts.count_tokens(docs.limit(0), path, 512).count() == 0
    for _ in range(150):
        text = "".join(rng.choice("ab .\n\té1<|endoftext|>") for _ in range(400))
        assert token_counts.count_huge(text, coder, 60, 4) == len(coder.encode(text, add_special_tokens=False))


def test_flac_and_media(docs):
    rng = np.random.default_rng(3)
    payloads = [media.payload(t) for _, t in ROWS] + [rng.integers(0, 256, 192 * 5, dtype=np.uint8).tobytes()]
    streams = flac.encode(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode(streams)] == payloads
    long = next(k for k, p in enumerate(payloads) if len(p) > 8000)
    assert (flac.read_from(streams[long], 7000, 9) + 128).astype(np.uint8).tobytes() == payloads[long][7000:7009]
    broken = bytearray(streams[long])
    broken[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])
    out = media.read_media(media.to_media(docs), carry=("n_bytes",)).collect()
    want = {hashlib.sha256(p).hexdigest() for p in payloads[:-1]}
    assert {r.payload_sha256 for r in out} == want and len(out) == len(ROWS)
    blocks = media.pcm_blocks(media.to_media(docs), block=1000).where("doc_id = 10").orderBy("block_no").collect()
    assert [b.sample_offset for b in blocks] == [1000 * k for k in range(len(blocks))]
    one = next(r for r in out if r.n_bytes == len(ROWS[11][1].encode()))
    stored = media.payload(ROWS[11][1])
    assert (one.tail_crc32, one.payload_bytes) == (zlib.crc32(stored[-16:]), len(stored))
    with pytest.raises(ValueError):
        media.join_pcm([(0, b"ab", zlib.crc32(b"ab")), (3, b"c", zlib.crc32(b"c"))])
    assert media.read_media(media.to_media(docs.limit(0)), carry=("n_bytes",)).count() == 0


def brute_components(made):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in made]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def test_jaccard(spark, docs):
    rng, made = random.Random(4), list(ROWS)
    passage = sentence(56, rng)
    made += [(100 + k, passage + " " + sentence(k % 24 + 1, rng)) for k in range(60)]
    for k in range(40):
        w = BASE.split()
        w[rng.randrange(200)] = f"v{k}"
        made.append((200 + k, " ".join(w)))
    assert rows(jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"))) == brute_components(made)
    # Loose sets that share most of a passage, more than fit in one block, some of which link.
    common, rng = sentence(70, rng), random.Random(8)
    made = [(k, common + " " + sentence(24 + k % 7, rng)) for k in range(300)]
    for k in range(0, 60, 2):
        w = made[k][1].split()
        made.append((1000 + k, " ".join(w[: len(w) - 3 - k % 5])))
    assert rows(jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"))) == brute_components(made)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {None, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14}
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(6)
    text = {"xx": lambda: " ".join(rng.choice(["the", "tion", "erea"]) for _ in range(30)), "yy": lambda: " ".join(rng.choice(["der", "schön", "keit"]) for _ in range(30))}
    data = [(k, text[lang](), lang) for k in range(200) for lang in (("xx", "yy")[k % 2],)] + [(900, None, "xx"), (901, "12 34 !", "yy"), (902, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert all(out[k].lang_pred == lang and 0 <= out[k].score <= 1 for k, _, lang in data[:200])
    assert {out[k].lang_pred for k in (900, 901, 902)} == {"und"}
    empty = df.limit(0)
    assert [r.lang_pred for r in langid.identify(df.limit(1), langid.train(empty)).collect()] == ["und"]


def folded(text):
    return [ord(c.casefold()) if len(c.casefold()) == 1 else ord(c) for c in text]


def grams_of(codes, sizes, bits):
    for n in sizes:
        for k in range(len(codes) - n + 1):
            yield int(spans.character_grams(np.array(codes[k : k + n], np.uint32), n, bits)[0])


def test_language_and_quality_against_brute_force(spark):
    texts = ["Schöne GRÜSSE aus Köln", "the quick brown fox", "日本語のテキスト", "Привет МИР", "a😀b", "", "é", "12"]
    data = [(k, texts[k % 4] + f" {k}", ("de", "en", "ja", "ru")[k % 4]) for k in range(80)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df)
    rows_of = [(900 + k, t, None, "clash") for k, t in enumerate(texts)] + [(900, texts[0], None, "again"), (990, None, None, "clash")]
    asked = spark.createDataFrame(rows_of, "doc_id long, text string, lang string, score string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(asked, model).collect())
    want = []
    for i, t, *_ in rows_of:
        if not any(map(str.isalpha, t or "")):
            want.append((i, "und", 0.0))
            continue
        found = list(grams_of(folded(t), langid.SIZES, langid.BITS))
        logs = model.prior + sum(model.table[f].astype(float) for f in found)
        odds = np.exp((logs - logs.max()) / max(1.0, len(found) / 100))
        want.append((i, model.languages[int(logs.argmax())], float(odds.max() / odds.sum())))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], rel=1e-4)

    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.train(df, labels)
    table, base = model.folded()
    got = sorted((r.doc_id, r.score) for r in quality.score(asked, model).collect())
    want = []
    for i, t, *_ in rows_of:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        found = [int(x) for x in quality.word_buckets(raw, np.array([0, len(raw)]))[0]] + list(grams_of([ord(c) for c in t or ""], quality.SIZES, quality.BITS))
        want.append((i, 1 / (1 + np.exp(-(base + sum(float(table[f]) for f in found) / max(1, len(found)))))))
    assert [x[0] for x in got] == [x[0] for x in sorted(want)] and [x[1] for x in got] == pytest.approx([x[1] for x in sorted(want)], rel=1e-4)
    assert quality.score(asked.limit(0), model).count() == langid.identify(asked.limit(0), langid.train(df)).count() == 0


def test_quality(spark):
    data = [(k, sentence(40) if k % 3 else " ".join(w + "$$$" for w in sentence(40).split())) for k in range(400)]
    df = spark.createDataFrame([*data, (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)] + [(5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.score(df, quality.train(df, labels)).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([out[k].predicted == int(k % 3 > 0) for k in held]) > 0.95 and 0 <= out[999].score <= 1


def brute_dedup(data):
    first = {}
    for i, t in data:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            if i is not None:
                first[raw[s : s + 50]] = min(i, first.get(raw[s : s + 50], i))
    for i, t in data:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if i is not None and first[raw[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        yield i, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest()


def test_suffix_dedup(spark, docs):
    data = [*ROWS, (20, "x" * 120), (21, "y" * 70 + BASE[100:150] + "é" * 60), (22, BASE[:49]), (23, BASE[37:101] + "!" + BASE[37:101])]
    assert rows(suffix_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"))) == sorted(brute_dedup(data), key=str)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_ids_that_share_a_slot(spark):
    assert len(set(runtime._slots(np.array([398, 1540])).tolist())) == 1
    rng = random.Random(9)
    one, two, copied = (sentence(30, rng) for _ in range(3))
    data = [(1, copied), (398, copied), (1540, sentence(20, rng) + one), (2000, sentence(20, rng) + one), (398, sentence(20, rng) + two), (2001, sentence(20, rng) + two)]
    assert rows(suffix_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"))) == sorted(brute_dedup(data), key=str)


def test_suffix_dedup_gathers_homes_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(meeting, "GATHERED", 300)
    rng = random.Random(12)
    shared = [sentence(14, rng) for _ in range(6)]
    data = [(rng.randrange(400), " ".join(rng.choice([*shared, sentence(3, rng), sentence(9, rng)]) for _ in range(4))) for _ in range(300)]
    long = "".join(rng.choices("abcdefgh ", k=suffix_dedup.CHUNK + 3000))
    edge = suffix_dedup.CHUNK - 40
    data += [(500, long), (90, "z" + long[edge : edge + 90]), (600, long[edge - 70 : edge + 30] + "zzz" + shared[0] * 40), (None, long[:200])]
    for batch, rows_of in ((7, data), (1000, data[::-1])):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert rows(suffix_dedup.dedup(spark.createDataFrame(rows_of, "doc_id long, text string"))) == sorted(brute_dedup(data), key=str)


def test_suffix_dedup_cover_has_every_difference():
    assert {(a - b) % suffix_dedup.CYCLE for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.CYCLE))


def test_suffix_dedup_spans_and_kept_text(spark):
    data = [(1, BASE), (2, BASE), (3, "é" * 20 + BASE[10:90] + "!" + BASE[100:180] + "."), (4, "short"), (5, None), (None, BASE), (2, BASE)]
    out = suffix_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"), with_spans=True, with_kept=True).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(brute_dedup(data), key=str)
    text = {3: data[2][1].encode(), 4: b"short", 5: b""}
    for r in out:
        raw = text.get(r.doc_id, BASE.encode())
        gone = {k for s in r.spans for k in range(s.start, s.end)}
        assert bytes(r.kept) == bytes(x for k, x in enumerate(raw) if k not in gone)
        assert len(gone) == r.n_removed and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert [[tuple(s) for s in r.spans] for r in out if r.doc_id == 3] == [[(40, 120), (121, 201)]]


def test_pii(docs):
    found = {r.doc_id: r.pii for r in pii.find_pii(docs).collect()}[14]
    text = ROWS[-1][1]
    cut = {k: [text[s.start : s.end] for s in found[k]] for k in pii.KINDS}
    assert cut == {"email": ["a.b@c.example.org"], "ip": ["10.0.0.255"], "card": ["4111 1111 1111 1111"], "phone": ["+49 (30) 1234-5678"], "iban": ["GB82 WEST 1234 5698 7654 32"], "ssn": ["123-45-6789", "123-45-6780"]}
    redacted = {r.doc_id: r for r in pii.redact(docs, chars_col=None).collect()}
    assert redacted[14].text.startswith("mail [EMAIL], ip [IP] and 1.2.3.999, card [CARD], call [PHONE], iban [IBAN]") and redacted[4].text is None
    assert redacted[1].text == BASE and redacted[1].n_tokens == "clash"


def test_token_files(docs):
    path = P.path("word_bpe_49k.json")
    coder = token_counts.tokenizer(path)
    files, _ = token_output.token_files(docs, path, 2)
    got = token_output.read_digests(files).collect()
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    name = files.where("n_docs > 1").first().file
    store, at = token_output.filesystem(name)
    with store.open_input_file(at) as file:
        reader = token_output.Reader(file)
        assert [reader.document(k).tobytes() for k in range(len(reader.ids))] == [bytes(x) for _, x in reader.documents()]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [(i, t, "en", "s", len(t or "")) for i, t in ROWS if i is not None]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(20)), (2, ROWS[6][1] + " three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 7, 9, 10, 11, 12, 13, 14}
    coder = bpe_codec.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert list(out[1].token_ids) == coder.encode_ordinary(BASE)
    assert b"[EMAIL]" in coder.decode_bytes(list(out[14].token_ids))


def test_empty_tables_and_rows_without_id(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("none", []), ("odd", [(None, BASE, "en", "s", 1), (None, None, None, None, None), (3, BASE, "en", "s", 1), (3, BASE, "en", "s", 1), (4, None, None, None, None)])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert bpe_codec.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == len(data)
        assert pii.find_pii(docs).count() == pii.redact(docs).count() == len(data)
        files, _ = token_output.token_files(docs, P.path("word_bpe_49k.json"), 2)
        assert token_output.read_digests(files).count() == len(data)
        assert suffix_dedup.dedup(docs).count() == jaccard_join.jaccard_components(docs).count() == len(data)
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted(str(r.doc_id) for r in out) == ([] if not data else ["3", "None"])
