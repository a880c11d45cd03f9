import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sheafline.llm import bpe_tree, language_tree, parsed_repeats, qgram_leaks, ring_shards, scaled_sketch, simhash_gray, token_counts, toxicity, warc
from sheafline.llm.common import new_path
from sheafline.llm.components import components, local_roots
from tokenizers import Tokenizer

SF = Path("/root/testdata/sf0.001")
PASSAGE = "".join(f"w{i * 7919 % 1000} " for i in range(80))
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_row(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- tokens


@pytest.mark.parametrize("name", ["docs", "hard_docs"])
def test_token_counts(request, name):
    df, library = request.getfixturevalue(name), Tokenizer.from_file(WORD)
    want = by_row(
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048)
        for i, t in texts(df)
    )
    assert by_row(token_counts.token_counts(df, WORD, block_chars=20_000).collect()) == want


@pytest.mark.parametrize("name", ["docs", "hard_docs"])
def test_bpe_round_trip(request, name):
    df, library = request.getfixturevalue(name), Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in texts(df):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    got = Counter(
        (r.doc_id, r.n_tokens, bytes(r.ids), r.decoded)
        for r in bpe_tree.bpe_round_trip(df, BYTE, leaf_chars=50).collect()
    )
    assert got == want


CODER, LIBRARY = bpe_tree.TreeBPE(BYTE, leaf_chars=5), Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            [
                "a", "the", "ing", "'s", "'", "'ll", " ", "   ", "\n", "é", "日本", "!", "..", "12", "😀", "\r", "\t", "–",
                "«", "'re", "\x1c", "\xa0", "½", "<|endoftext|>", " ", "X"
            ]
        ),
        max_size=60
    ).map("".join)
)
def test_tree_concatenation_agrees_with_the_library(text):
    ids = CODER.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids and CODER.decode(ids) == text


def test_every_long_text_goes_through_the_tree():
    """As the library has it, on all texts of documents, with joins in each that is longer than a leaf."""
    import pyarrow.parquet as pq

    coder = bpe_tree.TreeBPE(BYTE)
    long = 0
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        if text is None or len(text) <= coder.leaf_chars:
            continue
        before, long = coder.joins, long + 1
        assert np.frombuffer(
            coder.encode_batch([text])[0], "<u4"
        ).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert coder.joins > before
    assert long


# --- sharding


@pytest.mark.parametrize("name", ["docs", "hard_docs", "no_docs"])
def test_ring_shards(request, name):
    df = request.getfixturevalue(name)
    rows = ring_shards.ring_shards(df).collect()
    assert by_row((r.doc_id, r.size, r.text_crc32) for r in rows) == by_row(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        for i, t in texts(df)
    )
    counts = Counter(r.shard for r in rows)
    assert not rows or max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_equal_texts_share_a_shard(spark):
    """Where counts leave room, no group of equal texts is parted; one that no shard can hold is."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ring_shards.ring_shards(df).collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    text = {i: t for i, t in texts(df)}
    shards: dict = {}
    for r in rows:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(x) > 1 for x in shards.values()) == 0 < sum(n > 1 for n in Counter(text.values()).values())
    hot = spark.createDataFrame([(i, "same" if i < 60 else f"t{i}") for i in range(100)], "doc_id bigint, text string")
    got = Counter(r.shard for r in ring_shards.ring_shards(hot, shards=4, replicas=8).collect())
    assert got == dict.fromkeys(range(4), 25)


def ranges_of(at, k, slack):
    nodes, owner = ring_shards.virtual_nodes(k)
    arcs = Counter(zip([True] * len(at), np.searchsorted(nodes, at).tolist(), strict=True))
    return ring_shards.assign(arcs, nodes, owner, ring_shards.capacities(len(at), k, slack)), nodes, owner


def test_ranges_are_what_a_plain_ring_does():
    """Row by row and round by round: each row asks its node, and those sent on ask the next."""
    at = np.sort(np.random.default_rng(1).integers(0, 2**63, 900))
    for k, slack in ((5, 0.0), (7, 0.2)):
        ranges, nodes, owner = ranges_of(at, k, slack)
        room = ring_shards.capacities(len(at), k, slack).tolist()
        want, waiting = {}, [(int(np.searchsorted(nodes, x)) % len(nodes), i) for i, x in enumerate(at)]
        runs = {}
        for node, i in waiting:
            runs.setdefault((node, i > 0 and at[i] > nodes[-1]), []).append(i)
        queue = sorted((node, min(rows), rows) for (node, _), rows in runs.items())
        while queue:
            later = []
            for node, _, rows in queue:
                while not room[owner[node]]:
                    node = (node + 1) % len(owner)
                for n, i in enumerate(rows):
                    if not room[owner[node]]:
                        later.append(((node + 1) % len(owner), i, rows[n:]))
                        break
                    want[i] = int(owner[node])
                    room[owner[node]] -= 1
            queue = later
        got = {i: s for a, b, s in ranges for i in range(a, b)}
        assert got == want


def test_a_further_shard_moves_few_rows_where_there_is_room():
    at = np.sort(np.random.default_rng(0).integers(0, 2**63, 20_000))

    def shards_of(k, slack):
        out = np.empty(len(at), int)
        for a, b, s in ranges_of(at, k, slack)[0]:
            out[a:b] = s
        assert np.bincount(out, minlength=k).max() <= ring_shards.capacities(len(at), k, slack).max()
        return out

    before, after = shards_of(24, 0.25), shards_of(25, 0.25)
    assert (before != after).mean() < 0.12


# --- archives


def test_warc_round_trip_and_hot_payload(spark):
    pages = spark.createDataFrame(
        [
            (i, "http://a/", "x" * 200 if i % 3 else f"page {i}")
            for i in range(60)
        ] + [(None, None, "x" * 200), (60, "u\r\nv", None), (1, "u", "x" * 200)],
        "page_id bigint, url string, html string"
    )
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, f"{path}/part-*").collect()
    assert all(r.reason is None for r in got) and len(got) == 63
    kinds = Counter((r.record_type, r.refers_to) for r in got if r.payload_bytes == 200)
    assert kinds == {("response", None): 2, ("revisit", "urn:page:1"): 40}
    warc.write_warc(pages.limit(0), empty := new_path(spark, "warc"))
    assert warc.read_warc(spark, f"{empty}/*").where("record_type is not null").count() == 0


def test_salvage_finds_what_lies_behind_the_damage():
    r = random.Random(1)
    records = [
        warc.record_bytes(f"urn:page:{i}", "u", bytes(r.randrange(32, 127) for _ in range(r.randrange(0, 900))), "")
        for i in range(12)
    ]
    records = [x.replace(b"WARC-Payload-Digest: sha256:\r\n", b"") for x in records]
    for pack in (warc.member, lambda x: x):
        units = [pack(x) for x in records]
        starts = np.cumsum([0, *map(len, units)])
        data = bytearray(b"".join(units))
        assert [x["record_id"] for x in warc.salvage(bytes(data))] == [f"urn:page:{i}" for i in range(12)]
        data[starts[4] + len(units[4]) // 2] ^= 255
        data[starts[8]] ^= 1
        found = list(warc.salvage(bytes(data[:-5])))
        assert [x["record_id"] for x in found if "record_id" in x] == [
            f"urn:page:{i}"
            for i in range(11)
            if i not in (4, 8)
        ]
        assert [(x["start"], x["end"]) for x in found if "reason" in x] == [
            (starts[4], starts[5]), (starts[8], starts[9]), (starts[11], len(data) - 5)
        ]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_within_members(level):
    import gzip

    r = random.Random(2)
    records = [
        warc.record_bytes(
            f"urn:page:{i}", "u", bytes(r.randrange(32, 127) for _ in range(900)), hashlib.sha256(b"").hexdigest()
        )
        for i in range(12)
    ]
    records = [
        x.replace(b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"").hexdigest().encode() + b"\r\n", b"")
        for x in records
    ]
    ids = lambda data: [x["record_id"] for x in warc.salvage(data) if "record_id" in x]
    name = lambda *places: [f"urn:page:{i}" for i in places]
    pack = lambda x: gzip.compress(b"".join(x), level, mtime=0)
    bad = [x[:-50] + b"#" + x[-49:] if i == 4 else x for i, x in enumerate(records)]
    found = list(warc.salvage(pack(bad)))
    assert [x.get("record_id") for x in found] == [
        *name(*range(4)), None, *name(*range(5, 12))
    ] and found[4]["reason"] == "block digest differs"
    whole = pack(records)
    assert ids(whole) == name(*range(12))
    cut = ids(whole[: len(whole) * 2 // 3])
    assert cut == name(*range(len(cut))) and len(cut) >= 6
    assert ids(whole[:-8] + bytes(8)) == name(*range(12))  # the member's check differs, the records' own do not
    two = bytearray(pack(records[:6]) + pack(records[6:]))
    two[len(pack(records[:6])) * 2 // 3] ^= 255
    got = ids(bytes(two))
    assert got[:3] == name(0, 1, 2) and got[-6:] == name(*range(6, 12)) and len(set(got)) == len(got)


# --- language


def test_language_tree(spark, docs, hard_docs, no_docs):
    rows = language_tree.op4_language_tree(spark, str(SF)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    model = language_tree.fit(docs)
    got = {r.doc_id: r for r in language_tree.identify(hard_docs, model).collect()}
    assert {
        i
        for i, r in got.items()
        if r.lang_pred == "und"
    } == {3, 4, 8, 9} and all(0 <= r.score <= 1 for r in got.values())
    assert language_tree.fit(no_docs) is None
    assert {r.lang_pred for r in language_tree.identify(hard_docs, None).collect()} == {"und"}
    kept = language_tree.language_stage(spark, hard_docs, "")
    assert kept.columns == hard_docs.columns and not {3, 4, 8, 9} & {r.doc_id for r in kept.collect()}


def test_letters():
    from unicodedata import category

    for text in ("½ ² ①", "Ⅷ", "²", "42 % !", "", "٣", "é", "½ a", "日"):
        assert bool(language_tree.letters_of(text)) == any(category(c)[0] == "L" for c in text)


def test_features_and_predictions_against_plain_ones(docs, monkeypatch):
    sample = [t for _, t in texts(docs) if t][:60]
    langs = [r.lang or "en" for r in docs.where("text is not null").collect()][:60]
    model = language_tree.LanguageTree(sample, langs)

    def plain(text):
        out, t = np.zeros(language_tree.BIGRAMS + language_tree.TRIGRAMS), language_tree.letters_of(text)
        for n, size, first in ((2, language_tree.BIGRAMS, 0), (3, language_tree.TRIGRAMS, language_tree.BIGRAMS)):
            for p in range(len(t) - n + 1):
                key = 0
                for c in t[p : p + n]:
                    key = (key << 21 | ord(c)) % 2**64
                out[first + int(language_tree.mix64(np.array([key], np.uint64))[0]) % size] += 1
        out = np.sqrt(out)
        return out / max(np.linalg.norm(out), 1e-9)

    wanted = np.array([plain(t) for t in sample[:12]])
    for step in (language_tree.STEP, 50):  # long texts in steps
        monkeypatch.setattr(language_tree, "STEP", step)
        assert np.allclose(language_tree.features(sample[:12]), wanted, atol=1e-6)
    got, _ = model.predict(wanted.astype(np.float32))
    for x, lang in zip(wanted, got, strict=True):
        p = lambda i: 1 / (  # noqa: B023, E731
            1
            + np.exp(-((x @ model.weights[:, i] + model.bias[i]) * model.scale[i, 0] + model.scale[i, 1]))
        )
        n = len(model.families) if len(model.families) > 1 else 0
        family = max(range(n), key=p) if n else 0
        votes = Counter(dict.fromkeys(model.members[family], 0))
        for i, (f, a, b) in enumerate(model.pairs):
            if f == family:
                q = p(n + i)
                votes[a] += (q >= 0.5) + 1e-3 * q
                votes[b] += (q < 0.5) + 1e-3 * (1 - q)
        assert lang == max(votes, key=votes.get)


def test_a_rare_language_is_learned(spark):
    rows = [
        (
            i, f"the one and the other of them {i}" if i % 100 else "der eine und die andere von ihnen",
            "en" if i % 100 else "de"
        )
        for i in range(4_000)
    ]
    model = language_tree.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=50)
    assert model.langs == ["de", "en"]


# --- toxicity


def test_kernel_and_table_against_a_plain_subsequence_kernel():
    words = ["idiot", "id1ot", "i", "trash!", "tra-sh", "übel", "", "xx" * 20]

    def plain(word):
        c, out = toxicity._codes(word), Counter()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i - 2)
        # Repeated triples are weighed one by one in the norm.
        norm = sum(
            toxicity.DECAY ** (2 * (k - i - 2))
            for i in range(len(c))
            for j in range(i + 1, len(c))
            for k in range(j + 1, min(len(c), i + toxicity.SPAN))
        ) ** 0.5
        return {t: w / norm for t, w in out.items()}

    made = [plain(w) for w in words]
    want = [[sum(w * b.get(t, 0) for t, w in a.items()) for b in made] for a in made]
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-5)
    text = ["so a trash! idiot." if i % 3 else f"plain words {i} here." for i in range(60)]
    model = toxicity.ToxicityModel(text, [int(i % 3 > 0) for i in range(60)], landmarks=12)
    score = model.score_words(["idiot", "plain"])
    table = lambda w: sum(
        x * model.table[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c]
        for (a, b, c), x in plain(w).items()
    )
    assert np.allclose(score, [table("idiot"), table("plain")], atol=1e-4)


def test_long_texts_are_scored_in_blocks():
    text = ["you idiot." if i % 3 else f"plain words {i} here." for i in range(60)]
    model = toxicity.ToxicityModel(text, [int(i % 3 > 0) for i in range(60)], landmarks=12)
    long = " ".join(f"word{i % 700} and more." for i in range(60_000)) + " you idiot."
    known: dict = {}
    sentences = list(toxicity.sentences_of(long))
    model.learn({w for s in sentences for w in s}, known)
    assert model.score([long * 3], {})[0] == pytest.approx(model.score([long * 3], known)[0])
    assert model.features(iter(sentences), {}) == pytest.approx(
        model.features(iter(sentences[-1:] + sentences[:-1]), {})
    )



def test_toxicity_tolerates_gaps_and_insertions(spark, hard_docs, no_docs):
    r = random.Random(3)
    plain = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrt')}{r.choice('aeiou')}" for _ in range(300)]
    say = lambda *extra: " ".join(r.sample(plain, 20)) + ". " + " ".join([*r.sample(plain, 6), *extra]) + "."
    bad = ["wretchling", "snivelgob", "mudgrubber"]
    y = [i % 4 == 0 for i in range(600)]
    model = toxicity.ToxicityModel([say(r.choice(bad)) if t else say() for t in y], [int(t) for t in y], landmarks=60)
    clean = model.score([say() for _ in range(100)], {})
    gapped = model.score(
        [
            say(w)
            for w in ("wret.chling", "w r e t c h l i n g", "snivvelgob", "mudgrubxber", "SNIVELGOB!!")
            for _ in range(20)
        ],
        {}
    )
    assert (clean < 0.3).mean() > 0.9 and (gapped >= 0.3).mean() > 0.9
    got = toxicity.toxicity(hard_docs, model).collect()
    assert len(got) == hard_docs.count() and all(0 <= x.score <= 1 for x in got)
    assert toxicity.toxicity(no_docs, model).count() == 0
    assert toxicity.ToxicityModel(["a"], [0]).score(["b", ""], {}).tolist() == [0.0, 0.0]


@pytest.mark.parametrize(("sf", "least"), [("0.01", 0.68), ("0.1", 0.95)])
def test_toxicity_held_out(spark, sf, least):
    """The area under the curve on held-out labels; the smaller table has 14 toxic ones, and 37 to learn from."""
    rows = {r.doc_id: r for r in toxicity.op1_toxicity(spark, f"/root/testdata/sf{sf}").collect()}
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet").collect()
    held = [(r.toxic, rows[r.doc_id].score) for r in labels if r.doc_id in rows and rows[r.doc_id].held_out]
    pairs = [(a, b) for t, a in held if t for u, b in held if not u]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > least


# --- repeats


def brute_repeats(rows, length=200):
    seen = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1]))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("large", [parsed_repeats.LARGE_GROUP, 1])
@pytest.mark.parametrize("name", ["docs", "hard_docs", "no_docs"])
def test_repeats(request, monkeypatch, name, large):
    monkeypatch.setattr(parsed_repeats, "LARGE_GROUP", large)
    df = request.getfixturevalue(name)
    rows = [(i, t if t is None or len(t) < 20_000 else t) for i, t in texts(df)]
    assert by_row(parsed_repeats.repeat_digests(df).collect()) == brute_repeats(rows)


@pytest.mark.parametrize("name", ["docs", "hard_docs"])
def test_repeats_of_texts_longer_than_a_step(request, monkeypatch, name):
    monkeypatch.setattr(parsed_repeats, "BATCH_BYTES", 333)
    df = request.getfixturevalue(name)
    assert by_row(parsed_repeats.repeat_digests(df).collect()) == brute_repeats(texts(df))


def test_repeats_stage(spark, hard_docs):
    left = {r.doc_id: r for r in parsed_repeats.repeats_stage(spark, hard_docs, "").collect()}
    assert left[6].text == "left" and left[7].text == "right " and left[6].n_chars == 4 and 5 not in left and left[3].text is None


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.tuples(st.text("ab\0", min_size=9, max_size=30), st.integers(0, 8), st.integers(1, 2)), min_size=1,
        max_size=8
    )
)
def test_order_of_strings_around_a_trigger(rows):
    """Neighbours in the order of dictionary and parse suffixes are the strings that a plain count finds."""
    bodies = [x.encode()[: k + 1] + b"TRIG" + x.encode()[k + 1 :] for x, k, _ in rows]
    at, counts = (np.array([len(r[0][: r[1] + 1]) for r in rows]), np.array([float(r[2]) for r in rows]))
    length, keep = 12, []
    for b, a in zip(bodies, at, strict=True):  # only strings that hold the trigger
        lo, hi = max(0, a + 4 - length), min(a, len(b) - length)
        keep.append((b[lo : hi + length], a - lo) if lo <= hi else None)
    at, counts, bodies = np.array(
        [k[1] for k in keep if k], np.int64
    ), counts[[k is not None for k in keep]], [k[0] for k in keep if k]
    if not bodies:
        return
    got = parsed_repeats.repeated_in(bodies, at, counts, np.zeros(len(bodies), np.int64), length)
    for b, a, flags in zip(bodies, at, got, strict=True):
        total = [
            sum(
                n
                for c, x, n in zip(bodies, at, counts, strict=True)
                for q in range(len(c) - length + 1)
                if c[q : q + length] == b[p : p + length] and x - q == a - p
            )
            for p in range(len(flags))
        ]
        assert flags.tolist() == [t > 1 for t in total]


def test_a_trigger_in_very_many_surroundings(spark, monkeypatch):
    """A hot passage between texts that all differ, and a long run of one character."""
    monkeypatch.setattr(parsed_repeats, "LARGE_GROUP", 8)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = " ".join(word() for _ in range(40))
    rows = [
        (
            i,
            " ".join(word() for _ in range(r.randrange(30))) + passage[
                r.randrange(0, 60) : r.randrange(200, len(passage) + 40)
            ] + " ".join(word() for _ in range(r.randrange(30)))
        )
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_row(parsed_repeats.repeat_digests(df).collect()) == brute_repeats(rows)
    run = spark.createDataFrame([(1, "x" * 1_000_000), (2, "ab" * 500_000)], "doc_id bigint, text string")
    assert [
        (x.n_bytes, x.n_removed, x.n_spans)
        for x in parsed_repeats.repeat_digests(run).collect()
    ] == [(1_000_000, 1_000_000, 1)] * 2


def test_repeats_stage_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame(
        [(1, PASSAGE + "left", 1, "a", 2), (2, PASSAGE, 3, "b", 4), (3, None, 5, None, 6)],
        "doc_id bigint, text string, _rid int, spans string, row int"
    )
    got = sorted(tuple(x) for x in parsed_repeats.repeats_stage(spark, df, "").collect())
    assert got == [(1, "left", 1, "a", 2), (3, None, 5, None, 6)]


# --- near copies


def test_group_links_against_all_pairs():
    r = np.random.default_rng(2)
    for _ in range(15):
        codes = np.unique(
            np.array(
                [
                    int(b) ^ sum({1 << int(k) for k in r.integers(0, 64, r.integers(0, 6))})
                    for b in r.integers(0, 2**63, 12)
                    for _ in range(40)
                ],
                np.uint64
            )
        )
        a, b = simhash_gray.group_links(np.zeros(len(codes), int), codes)
        near = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
        place = {int(c): i for i, c in enumerate(codes)}
        links = [np.array([place[int(c)] for c in x], int) for x in (a, b)]
        assert (local_roots(len(codes), *near) == local_roots(len(codes), *links)).all()


def test_fingerprints_of_long_texts_in_steps(docs, monkeypatch):
    some = [t or "" for _, t in texts(docs)]
    whole = [simhash_gray.fingerprint(t) for t in some]
    monkeypatch.setattr(simhash_gray, "STEP", 40)
    assert [simhash_gray.fingerprint(t) for t in some] == whole


def test_links_of_one_group_of_any_size(spark):
    r = np.random.default_rng(5)
    codes = np.unique(
        np.array([sum({1 << int(k) for k in r.integers(0, 20, r.integers(0, 9))}) for _ in range(900)], np.int64)
        | np.int64(1 << 62)
    )
    near = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    place = {int(c): i for i, c in enumerate(codes)}
    df = spark.createDataFrame([(int(c),) for c in codes], "fp bigint")
    for got in (simhash_gray.ball_links(df), simhash_gray.near_links(df, 4, 100)):
        links = np.array([(place[x.a], place[x.b]) for x in got.collect()], int).T
        assert (local_roots(len(codes), *near) == local_roots(len(codes), *links)).all()
    with pytest.raises(ValueError, match="even"):
        simhash_gray.ball_links(df, 3)


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    want = local_roots(400, *np.array(links).T)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: want[i] for i in {x for p in links if p[0] != p[1] for x in p}}


@pytest.mark.parametrize("large", [simhash_gray.LARGE_GROUP, 2])
@pytest.mark.parametrize("name", ["docs", "hard_docs", "no_docs"])
def test_simhash_groups(request, monkeypatch, name, large):
    import xxhash

    monkeypatch.setattr(simhash_gray.near_links, "__defaults__", (4, large))
    df = request.getfixturevalue(name)
    rows = texts(df)

    def plain(t):
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    prints = [plain(t) for _, t in rows]
    near = np.nonzero([[(a ^ b).bit_count() <= 4 for b in prints] for a in prints]) if rows else (np.zeros(0, int),) * 2
    roots = local_roots(len(rows), *near)
    low = {}
    for (i, _), root in zip(rows, roots, strict=True):
        low[root] = min((x for x in (low.get(root), i) if x is not None), default=None)
    want = Counter(
        (i, p - (1 << 64) if p >> 63 else p, low[root])
        for (i, _), p, root in zip(rows, prints, roots, strict=True)
    )
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash_gray.simhash_groups(df).collect()) == want


def test_near_dedup_stage(spark, hard_docs):
    left = simhash_gray.near_dedup_stage(spark, hard_docs, "")
    assert left.columns == hard_docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id and r.doc_id <= 4) == [1, 3]


def test_near_dedup_judges_rows(spark):
    """Texts that share a doc_id, null ids, repeated rows and columns of any name."""
    one = "one two three four five six seven eight"
    rows = [
        (1, "a b c"), (1, "q r s t u"), (2, "a b c"), (None, "v w x y z"), (None, "v w x y z"), (3, one), (3, one),
        (3, one + " nine"), (None, one), (4, "only here now")
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "1 AS _place", "2 AS th", "3 AS root", "4 AS id", "5 AS row"
    )
    left = simhash_gray.near_dedup_stage(spark, df, "")
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert left.columns == df.columns and set(got.values()) == {1}
    assert set(got) - {(3, one), (3, one + " nine")} == {
        (1, "a b c"), (1, "q r s t u"), (None, "v w x y z"), (4, "only here now")
    } and len(got) == 5
    assert simhash_gray.near_dedup_stage(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("sizes", [(2, 1, 4), (2, 0, 3), (16, 3, 512)])
def test_near_dedup_against_brute_force(spark, monkeypatch, sizes):
    """Whatever is 0.8 alike in five-word shingles is one group, and nothing else is."""
    from sheafline.llm import shingle_copies

    monkeypatch.setattr(shingle_copies.copy_groups, "__defaults__", sizes)
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5_000)}"
    line = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([4, 6, 40, 150, 400]))] + (line if r.random() < 0.5 else [])
        for _ in range(4):
            text = list(base)
            for _ in range(r.randrange(0, 2 + len(base) // 50)):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "a b", "A  b", " ".join(line)])]

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    made = [sets(t) for _, t in rows]
    near = np.nonzero([[a == b or len(a & b) >= 0.8 * len(a | b) for b in made] for a in made])
    roots = local_roots(len(rows), *near)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert 5 < len(set(roots)) < len({frozenset(x) for x in made})
    assert sorted(
        x.doc_id
        for x in simhash_gray.near_dedup_stage(spark, df, "").collect()
    ) == sorted(set(roots.tolist()))


def test_sets_unlike_are_no_candidates(monkeypatch):
    """Of many sets in one list, pairs follow the alike, not the square; sketches of other lengths rule none of those out."""
    from sheafline.llm import shingle_copies

    monkeypatch.setattr(shingle_copies, "SKETCHED", 10_000)
    r = np.random.default_rng(5)
    some = lambda n: r.integers(0, 1 << 64, n, np.uint64, endpoint=False)
    base = some(130)
    sets = [np.unique(np.concatenate([base[r.random(130) < 0.8], some(r.integers(10, 40))])) for _ in range(300)]
    sets += [np.unique(np.concatenate([x, some(5)])) for x in sets[:20]]
    sets += [np.unique(x[: len(x) * 82 // 100]) for x in sets[20:40]]
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    alike = {
        (a, b) for b in range(len(sets)) for a in range(b)
        if (m := both(a, b)) * 100 >= (len(sets[a]) + len(sets[b]) - m) * shingle_copies.ALIKE
    }
    rows = [
        {
            "set_id": i, "n": len(x), "at": 0, "root": i, "hot": len(x), "last": 0, "block": 0,
            "sketch": shingle_copies.sketch(x)
        }
        for i, x in enumerate(sets)
    ]
    batch = pa.RecordBatch.from_pylist([{"sets": rows, "large": True, "across": False}])
    got = [
        (x["a"], x["b"]) for part in shingle_copies._candidates(None, 3)([batch]) for x in part.to_pylist()
    ]
    assert len({len(x["sketch"]) for x in rows}) > 1
    assert len(alike) >= 40 and alike <= set(got)
    assert len(got) < 2 * len(alike) < len(sets) ** 2 // 50


def test_common_shingles_of_all_texts(spark):
    """A shingle of nine texts is common in a table of any size; copies of a text count once."""
    from sheafline.llm import shingle_copies

    line = "this line stands in nine texts"
    rows = [(f"{line} a{i} b{i} c{i} d{i} e{i}",) for i in range(9)] + [("one text that has many copies",)] * 50
    rows += [(f"v{i} w{i} x{i} y{i} z{i}",) for i in range(45_000)]
    df = spark.createDataFrame(rows, "text string").selectExpr("text", "xxhash64(text) AS th")
    want = shingle_copies.shingles(line) >> np.uint64(shingle_copies.LOW)
    assert shingle_copies.common_shingles(df).tolist() == sorted(want.tolist())


# --- benchmark


def test_leaks_against_full_alignment(spark, docs, hard_docs, no_docs):
    r = random.Random(6)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(x.item_id, x.text) for x in benchmark.collect()] + [(900, "tiny 1"), (901, "!!"), (902, None)]
    index = qgram_leaks.ItemIndex([x for x in items if x[1]])
    for _ in range(120):
        _, item = r.choice(items[:-3])
        text = list(qgram_leaks.normal(item))
        limit = int(len(text) * qgram_leaks.EDITS)
        want = "".join(text)
        for _ in range(r.randrange(0, int(1.5 * limit))):
            at = r.randrange(len(text))
            text[at : at + r.randrange(2)] = r.choice(["", "x", "ab"])
        edited = "so it goes " + "".join(text) + " and on"
        got = {i: e for _, i, e, _ in index.search([edited])}
        assert [
            e
            for i, t in items
            if t == item
            for e in [got.get(i)]
        ][0] == qgram_leaks.edits_within(want, qgram_leaks.normal(edited), limit)
    assert [x[1:3] for x in index.search(["a TINY-1 b", "tiny 12"])] == [(900, 0)]
    plain = [(i, qgram_leaks.normal(t)) for i, t in texts(docs)]
    exact = {(i, k) for i, t in plain for k, x in items[:-3] if qgram_leaks.normal(x) in t}
    for block in (qgram_leaks.BLOCK_CHARS, 2_000):
        got = {
            (x.doc_id, x.item_id)
            for x in qgram_leaks.benchmark_leaks(docs, benchmark, block_chars=block).where("edits = 0").collect()
        }
        assert got == exact
    assert qgram_leaks.benchmark_leaks(hard_docs, benchmark).count() == 0 and qgram_leaks.benchmark_leaks(no_docs, benchmark).count() == 0
    assert qgram_leaks.benchmark_leaks(docs, benchmark.limit(0)).count() == 0
    left = {x.doc_id for x in qgram_leaks.leaks_stage(spark, docs, str(SF)).collect()}
    assert left == {i for i, _ in plain} - {i for i, _ in exact}


def test_leaks_of_items_without_an_id(spark, monkeypatch):
    first, second = ("".join(f"{w}{i} " for i in range(12)) for w in ("apple", "pear"))
    docs = spark.createDataFrame(
        [(1, f"so {first} on {second}"), (2, "tiny 1 too"), (3, "clean")], "doc_id bigint, text string"
    )
    benchmark = spark.createDataFrame(
        [(None, first), (None, second), (None, "tiny 1"), (None, None), (7, first)], "item_id bigint, text string"
    )
    for block in (qgram_leaks.BLOCK_CHARS, 50):
        got = qgram_leaks.benchmark_leaks(docs, benchmark, block_chars=block).collect()
        assert Counter((x.doc_id, x.item_id) for x in got) == {(1, None): 2, (1, 7): 1, (2, None): 1}
    monkeypatch.setattr(qgram_leaks, "table", lambda *_: benchmark)
    assert [x.doc_id for x in qgram_leaks.leaks_stage(spark, docs, "").collect()] == [3]


def test_leaks_of_many_items_of_one_template():
    import time

    items = [
        (i, f"Question {i}: what is the capital of the country that has number {i * 7919 % 100_003} in the long list?")
        for i in range(20_000)
    ]
    index = qgram_leaks.ItemIndex([*items, (20_000, items[5][1].upper())])
    began = time.time()
    got = index.search([items[5][1]])
    assert time.time() - began < 20
    assert {(i, e) for _, i, e, _ in got if e == 0} == {(5, 0), (20_000, 0)}
    for _, i, e, _ in random.Random(1).sample(got, min(20, len(got))):
        assert e == qgram_leaks.edits_within(
            qgram_leaks.normal(items[i % 20_000 if i < 20_000 else 5][1]), qgram_leaks.normal(items[5][1]), 20
        )


def test_leaks_in_long_texts(monkeypatch):
    monkeypatch.setattr(qgram_leaks, "BATCH_CHARS", 500)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(6)]
    text = " ".join(
        [*(word() for _ in range(300)), items[3][1], *(word() for _ in range(50)), items[0][1].replace("a", "b", 3)]
    )
    index = qgram_leaks.ItemIndex(items)
    want = sorted(
        (0, i, e)
        for i, t in items
        if (e := qgram_leaks.edits_within(t, qgram_leaks.normal(text), int(len(t) * 0.1))) is not None
    )
    assert [x[:3] for x in index.search([text])] == want and len(want) == 2


def plain_edits(item, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.text("abc", min_size=1, max_size=9), st.text("abc", max_size=14), st.integers(0, 9)), min_size=1,
        max_size=6
    )
)
def test_alignments_side_by_side(rows):
    items, regions, limits = zip(*rows, strict=True)
    want = [e if (e := plain_edits(a, b)) <= k else -1 for a, b, k in rows]
    assert qgram_leaks.edits_within_each(list(items), list(regions), np.array(limits)).tolist() == want


# --- sketches


def plain_sketch(text):
    """Shingle by shingle, with whole numbers of Python."""
    from sheafline.llm.common import BASE, RollingHash

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    code = [int(x) for x in RollingHash._bytes]
    hash_of = lambda b: mix(sum(code[c] * pow(BASE, i, 2**64) for i, c in enumerate(b)) % 2**64)
    n, k = len(text), scaled_sketch.SHINGLE
    every = {hash_of(text[i : i + k]) for i in range(n - k + 1)} if n >= k else {mix(hash_of(text) ^ n)} if n else set()
    below = sorted(x for x in every if x < 2**64 // scaled_sketch.SCALE)
    return max(below, sorted(every)[: scaled_sketch.LEAST], key=len)


@pytest.mark.parametrize("step", [scaled_sketch.STEP, 37])
def test_sketches_against_plain_ones(docs, step):
    some = [(t or "")[-600:].encode() for _, t in texts(docs)][:25] + [b"", b"short", b"x" * 16, "é".encode() * 40]
    got = scaled_sketch.sketches(some, step=step)
    assert [x.tolist() for x in got] == [plain_sketch(x) for x in some]


def test_likeness_over_many_and_empty_ranges(spark):
    rows = [(i * 1000, f"text number {i} " * (i % 7)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = {r.doc_id: r for r in scaled_sketch.neighbour_likeness(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k, (i, t) in enumerate(rows):
        after = rows[k - 1][1]
        assert got[i].edited_sha256 == hashlib.sha256(scaled_sketch.edited(t, after).encode()).hexdigest()



@pytest.mark.parametrize("name", ["docs", "hard_docs", "no_docs"])
def test_sketches(request, name):
    df = request.getfixturevalue(name)
    rows = sorted(texts(df), key=lambda x: (x[0] is None, -(x[0] or 0)))
    one = lambda t: scaled_sketch.to_text(scaled_sketch.sketches([(t or "").encode()])[0])
    want = Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        edit = scaled_sketch.edited(t or "", after)
        near = [
            scaled_sketch.containment(scaled_sketch.from_text(one(t)), scaled_sketch.from_text(one(x)))
            for x in (edit, after)
        ]
        want[i, len(t or ""), hashlib.sha256(edit.encode()).hexdigest(), one(t), one(edit), *near] += 1
    assert by_row(scaled_sketch.neighbour_likeness(df).collect()) == want
    assert by_row(scaled_sketch.document_sketches(df).collect()) == by_row((i, one(t)) for i, t in rows)


def test_sketches_merge_and_estimate():
    r = random.Random(8)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(40_000)).encode() for _ in range(2))
    sa, sb, both, part = scaled_sketch.sketches([a, b, a + b, a[:8_000]])
    merged = scaled_sketch.merge(sa, sb)
    assert len(np.setdiff1d(merged, both)) == 0 and len(both) - len(merged) <= 16
    assert scaled_sketch.containment(part, both) == 1.0 and scaled_sketch.containment(sa, sb) == 0.0
    half = scaled_sketch.sketches([a[:20_000] + b[:20_000]])[0]
    assert abs(scaled_sketch.containment(half, sa) - 0.5) < 0.1


def test_short_texts_are_like_their_edited_texts():
    """However short, a text shares about two thirds of its shingles with its edited text, and all with itself."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    for size in (60, 120, 400, 3_000, 30_000):
        likes = []
        for _ in range(30):
            text, other = (" ".join(word() for _ in range(size // 6)) for _ in range(2))
            x, y = scaled_sketch.sketches([t.encode() for t in (text, scaled_sketch.edited(text, other))])
            likes.append(scaled_sketch.containment(x, y))
            assert scaled_sketch.containment(x, x) == 1.0
        assert 0.4 < np.mean(likes) < 0.75 and min(likes) > 0
    whole = " ".join(word() for _ in range(6_000))
    for n in (2_000, 8_000):
        x, y = scaled_sketch.sketches([whole[5_000 : 5_000 + n].encode(), whole.encode()])
        assert scaled_sketch.containment(x, y) == 1.0
