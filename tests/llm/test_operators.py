"""Each operator against brute force, round trips or held-out accuracy, and on awkward rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.llm import chat, components, decontaminate, fingerprint, jaccard_join, language_id, licenses, mixing, queries, shared_keys, substring_dedup, tokens, toxicity, warc

from ..oracle import connect, same
from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, keys string, n_words long"


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, nulls, empties, a very long text and short ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(300)]
    make = lambda n: rng.choices(words, k=n)
    passage, rows = make(60), []
    for i in range(40):
        w = make(rng.randint(0, 150))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        rows.append((i, " ".join(w)))
    base = make(120)
    for i in range(40, 60):
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(60, rows[3][1]), (61, rows[3][1].upper()), (62, None), (63, ""), (64, " \n\t"), (65, "one"), (66, "One"), (67, "one two"), (68, " ".join(make(9000))), (69, "é ü 漢字 x " * 30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), 0.5, 1, "k", 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


@pytest.fixture(scope="module")
def messy(spark, texts):
    """As ``docs`` with repeated rows, ids that repeat with other texts, and null ids."""
    return frame(spark, [*texts, texts[4], texts[4], (5, "another text of this id"), (None, texts[4][1]), (None, None), (None, "a text without id")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [3, 13, 50])
def test_substring_dedup(docs, texts, width):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_digest(docs, width).collect()}
    assert got == {i: (n, gone, brute.sha(kept)) for i, n, gone, kept in brute.cut(texts, width)}


def test_substring_dedup_texts(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = sorted((str(i), n, gone, kept if gone else None) for i, n, gone, kept in brute.cut(rows, 13))
    got = substring_dedup.substring_dedup(messy, 13)
    assert set(messy.columns) <= set(got.columns)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text if r.n_removed else None) for r in got.collect()) == want


def test_strip_reference(spark, docs, texts):
    reference = spark.createDataFrame([(texts[0][1],), (None,)], "text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.strip_reference(docs, reference, 13).collect()}
    for i, t in texts:
        _, _, gone, _ = brute.cut([(0, texts[0][1]), (1, t)], 13)[1]
        assert got[i] == gone
    with pytest.raises(ValueError):
        substring_dedup.strip_reference(docs, reference, 13, most=10)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=10), max_size=3), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.integers(1, 4))
def test_automaton(passages, words, least):
    have = {tuple(p[i : i + least]) for p in passages for i in range(len(p) - least + 1)}
    want = set()
    for i in range(len(words) - least + 1):
        if tuple(words[i : i + least]) in have:
            want |= set(range(i, i + least))
    assert {k for a, b in substring_dedup.SuffixAutomaton(passages).spans(words, least) for k in range(a, b)} == want


# --- 2 ---------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "ask", {"n_chars": "3", "prompt": '"x"'}, None), (1, "b", 1, "ask", {"prompt": '"q"'}, "a"), (1, "c", 2, "ask", {"n_chars": '"3"', "prompt": '"x"'}, "b"), (1, "c", 2, "ask", {"n_chars": '"3"', "prompt": '"x"'}, "b"),
         (1, "d", 3, "ask", {"n_chars": "1", "prompt": '"x"', "zzz": "1"}, "gone"), (1, "e", 4, "nope", {}, "f"), (1, "f", 5, "ask", None, "e"), (2, "a", 0, "ask", {"n_chars": "1", "prompt": '"x"'}, "a"), (None, "a", 0, "ask", {}, None)],
        "conv_id long, call_id string, turn long, name string, arguments map<string,string>, after string")
    results = spark.createDataFrame([(1, "a", 1, 'say "hi"\n'), (1, "zz", 9, None), (1, "a", 2, "later")], "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame(chat.TURN_SCHEMAS, "name string, key string, kind string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in chat.link_tool_calls(calls, results, schemas).collect()}
    assert {k: (r.status, r.depth, r.error, r.copies) for k, r in got.items()} == {
        (1, "a"): ("linked", 0, None, 1), (1, "b"): ("open", 1, "missing n_chars", 1), (1, "c"): ("open", 2, "not a integer: n_chars", 2), (1, "d"): ("open", 0, "unknown zzz", 1),
        (1, "e"): ("cyclic", None, "unknown tool", 1), (1, "f"): ("cyclic", None, "missing n_chars", 1), (2, "a"): ("cyclic", None, None, 1), (1, "zz"): ("orphan", None, None, None),
    }
    assert got[1, "a"].json == '{"arguments":{"n_chars":3,"prompt":"x"},"content":"say \\"hi\\"\\n","id":"a","name":"ask","status":"linked"}'


def test_chat_of_turns(spark):
    import json

    rows = queries.op2_chat_formatting(spark, SF).collect()
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    asked = [r for r in rows if r.status != "orphan"]
    assert len(asked) == sum(t.role in ("user", "system") for t in turns.values())
    for r in asked:
        held = json.loads(r.json)
        assert held["arguments"]["prompt"] == turns[r.conv_id, r.turn].text and r.error is None
        after = turns.get((r.conv_id, r.turn + 1))
        assert (r.status == "linked") == (after is not None and after.role == "assistant")
        assert held["content"] == (after.text if r.status == "linked" else None)
        assert r.json == json.dumps(held, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_turns_of_other_roles_make_rows(spark):
    turns = [(1, 0, "system"), (1, 1, "user"), (1, 2, "tool"), (1, 3, "assistant"), (1, 4, None), (1, 5, "ask"), (2, 0, "User")]
    rows = spark.createDataFrame([(c, t, r, f"text {t}") for c, t, r in turns], "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.call_id): (r.name, r.status, r.error, r.result_turn) for r in chat.link_tool_calls(*chat.turns_as_calls(rows)).collect()}
    assert got == {
        (1, "t0"): ("instruct", "open", None, None),
        (1, "t1"): ("ask", "open", None, None),
        (1, "t2"): ("role:tool", "linked", "unknown tool", 3),
        (1, "t4"): (None, "open", "unknown tool", None),
        (1, "t5"): ("role:ask", "open", "unknown tool", None),
        (2, "t0"): ("role:User", "open", "unknown tool", None),
    }


# --- 3 ---------------------------------------------------------------------------------------


def plain_kernel(s, t, n, decay):
    """Lodhi's recursion, letter by letter."""

    def inner(i, a, b):
        if not i:
            return 1.0
        if min(a, b) < i:
            return 0.0
        return decay * inner(i, a - 1, b) + sum(inner(i - 1, a - 1, j) * decay ** (b - j + 1) for j in range(b) if t[j] == s[a - 1])

    return sum(inner(n - 1, a - 1, j) * decay**2 for a in range(n, len(s) + 1) for j in range(len(t)) if t[j] == s[a - 1])


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_subsequence_kernel(a, b):
    got = toxicity.raw_kernel(toxicity._padded([a.encode()]), toxicity._padded([b.encode()]))[0]
    assert got == pytest.approx(plain_kernel("^" + a, "^" + b, toxicity.ORDER, toxicity.DECAY), rel=1e-5, abs=1e-9)


def test_toxicity_learns(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(2, 7)))
    sentence = lambda bad=None: " ".join([*(word() for _ in range(8)), *([bad] if bad else []), word()]) + ". "
    rows = [(i, "".join(sentence(rng.choice(["blockhead", "dumbo"]) if i % 3 == 0 and k < 2 else None) for k in range(5)), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") < 200)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 200]) > 0.97
    plain, *odd = model.scores([b"quite fine.", b"b l o c k h e a d", b"you bl-ock.head", b"a blockxhead a blockxhead. blozckhead"])
    assert plain < 0.5 and min(odd) > 0.5, (plain, odd, model.landmarks)
    assert model.scores([None, b"", "漢字".encode()]) == [model.scores([b""])[0]] * 3
    assert toxicity.train(docs, labels.limit(0)).scores([b"x"]) == [0.0]


def test_toxicity_reads_words_that_lack_letters():
    marks = [b"stupid", b"clown", b"moron", b"disgusting", "réeux".encode()]
    model = toxicity.Model(marks, np.eye(5), np.zeros(5), 0.0, np.zeros(9), np.zeros(5))
    rng = random.Random(2)
    words = toxicity.words_of(b"st*pid cl*wn stup1d stepid m*ron disg*sting")
    words += ["".join(rng.choices("stupidclownré", k=rng.randint(2, 14))).encode() for _ in range(3000)]
    words += [z[:i] + c + z[i + n :] for z in marks for i in range(len(z)) for n, c in ((1, b""), (1, b"e"), (2, b""), (0, z[i : i + 1] * 3))]
    words = sorted(set(words) - {b""})
    got = model.values(words)
    for j, z in enumerate(marks):
        want = toxicity.kernel(words, z)  # of all words, without a filter
        assert [got[w][j] if w in got else 0.0 for w in words] == pytest.approx(list(want), rel=1e-4)
    assert got[b"stpid"][0] > 0.5 and got[b"clwn"][1] > 0.5 and got[b"disgsting"][3] > 0.75
    assert sum(toxicity.reachable(*toxicity.shared_letters(words), z).sum() for z in marks) < 5 * len(words)


def test_toxicity_finds_dropped_and_masked_letters():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(2, 7)))
    sentence = lambda bad=None: " ".join([*(word() for _ in range(8)), *([bad] if bad else []), word()]) + ". "
    rows = [("".join(sentence(rng.choice(["stupid", "clown"]) if i % 3 == 0 and k < 2 else None) for k in range(5)).encode(), i % 3 == 0) for i in range(300)]
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
    plain, *odd = model.scores([b"quite fine.", b"you st*pid man", b"a stpid thing", b"a cl*wn", b"stup1d"])
    assert plain < 0.5 and min(odd) > 0.5, (plain, odd, model.landmarks)


# --- 4 ---------------------------------------------------------------------------------------


def test_mixing(messy, empty):
    rows = mixing.mix(messy).collect()
    assert len(rows) == messy.count()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r["size"] and r["size"] == len(brute.WORD.findall(r.text or ""))
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].source_size == sum(r["size"] for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v) / 2 + 1
    assert sorted(map(str, mixing.mix(messy).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), ("d", 90), (None, 400)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weight, want, left = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {}, 1500.0
    size = {"a": 10, "b": 1000, "c": 0, "d": 90, None: 400}
    while True:
        open_ = [s for s in weight if s not in want]
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 3 * size[s]]
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 3.0 * size[s]
            left -= want[s]
    assert got == pytest.approx(want)


# --- 5 ---------------------------------------------------------------------------------------


def test_licenses(spark, messy):
    rows = [(1, "Under the MIT-License, Apache License: version 2.\nSPDX-License-Identifier: (GPL-2.0 OR BSD-3-Clause) AND CC0-1.0 WITH x"), (2, "under the mit licensee"), (3, None), (4, "CC BY NC cc by-nc"), (5, "é under the mit license")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].base_labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("apache-2,mit", 2, 0, 4)
    assert got[1].labels == "apache-2,bsd,cc0,gpl,mit"
    assert got[2].n_base == 0 and got[2].first_word is None and got[3].n_words == 0 and got[3].score == 0
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].commercial) == (2, 0, 3, False)
    assert got[5].first_word == 1
    found = licenses.license_scan(messy).collect()
    assert len(found) == messy.count()
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert sorted(r.n_words for r in found) == sorted(len(pattern.findall((r.text or "").translate(brute.LOWER))) for r in messy.collect())


@pytest.mark.parametrize("text, postfix, commercial, valid", [("MIT", "MIT", True, True), ("CC-BY-NC-4.0 OR MIT", "CC-BY-NC-4.0 MIT or", True, True), ("CC-BY-NC-4.0 AND MIT", "CC-BY-NC-4.0 MIT and", False, True), ("A OR B AND C WITH D", "A B C D with and or", True, True), ("(A OR B) AND C", "A B or C and", True, True), ("A OR", "A or", True, False), ("", "", False, False), ("(A", "A", True, False)])
def test_expressions(text, postfix, commercial, valid):
    x = licenses.parse(text)
    assert (" ".join(x.postfix), x.commercial, x.valid) == (postfix, commercial, valid)


# --- 6 ---------------------------------------------------------------------------------------


def test_language_gradients():
    rng = np.random.default_rng(0)
    model = language_id.Model.new(["a", "b"], hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    win, y = rng.integers(97, 101, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = model.gradients(win, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-2, -1e-2):
            model.weights[k][at] += step
            losses.append(model.gradients(win, y)[0])
            model.weights[k][at] -= step
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_language_id(spark):
    rows = queries.op6_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    model = language_id.train(spark.createDataFrame([(1, "abab abba baab", "x"), (2, "cdcd dccd ddcc", "y"), (3, None, "z"), (4, "q", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y"]
    assert language_id._predictions(model, [None, "", "12 !", "abba"])[0][:3] == ["und"] * 3
    runs = language_id.label_positions("abba cdcd", model)
    assert runs[0][0] == 0 and runs[-1][1] == 9


# --- 7 ---------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.binary(max_size=30))
def test_bit_parallel_distance(item, text):
    assert decontaminate.Pattern(item).best(text)[0] == brute.distance(item, text)


def test_decontamination(spark):
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    items = [(i, prose(rng.randint(40, 160))) for i in range(12)]
    rows = []
    for i in range(60):
        t = list(items[i % 12][1])
        for _ in range(rng.randint(0, 14)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([["z"], [], ["y", t[k]]])
        rows.append((i, prose(200) + "".join(t).upper() + prose(100)))
    rows += [(100, None), (101, ""), (102, prose(300)), (0, rows[0][1])]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")).collect()}
    want = {}
    for i, t in rows:
        for k, item in items:
            a, b = decontaminate.normal(item.encode()), decontaminate.normal((t or "").encode())
            d = brute.distance(a, b) if b else len(a)
            if d <= int(decontaminate.RATE * len(a)):
                want[i, k] = d
    assert got == want and len(want) > 20


# --- 8 ---------------------------------------------------------------------------------------


def plain_phrases(data):
    known, w = set(), b""
    for c in data:
        w += bytes([c])
        if w not in known:
            known.add(w)
            w = b""
    return known


def test_phrases():
    for data in (b"", b"a", b"aaaaaaaa", b"abracadabra" * 5):
        parser = fingerprint.Parser()
        whole = parser.feed(data)
        assert {p.encode("latin-1") for p in parser.known} == plain_phrases(data)
        other = fingerprint.Parser()
        parts = np.minimum(other.feed(data[:3]), other.feed(data[3:]))
        assert (parts == whole).all()


def test_fingerprint_pairs(messy, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 7)
    rows = sorted(((r.doc_id, r.text or "") for r in messy.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    print_of = lambda t: fingerprint.signature(fingerprint.Parser().feed(t.encode()))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = print_of(t), print_of(edited), print_of(after)
        want.append((str(i), len(t), brute.sha(edited), fingerprint.text_of(a), fingerprint.text_of(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert sorted((str(r[0]), *r[1:]) for r in fingerprint.fingerprint_pairs(messy).collect()) == sorted(want)


# --- 9 ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    gap = "\r\n\r\n"
    rows = [(1, "u", "x" * 300 + f"{gap}WARC/1.1{gap}"), (2, "u\r\nEvil: 1", "x" * 300 + f"{gap}WARC/1.1{gap}"), (3, "", ""), (4, None, None), (5, "a", "é" * 3000 + "\r\n"), (None, "a", f"q{gap}"), (6, "a", "\r\n" * 200), (2, "u", "x" * 300 + f"{gap}WARC/1.1{gap}"), (7, "s", "short"), (8, "s", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), chunk_bytes=1000)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(chunks).collect())
    want = sorted((str(i), len((t or "").encode()), brute.sha(t or ""), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, t in rows)
    assert got == want
    assert chunks.agg(F.max(F.length("bytes"))).first()[0] <= 1000
    whole = {}
    for r in sorted(chunks.where("page_id = 5").collect(), key=lambda r: r.chunk):
        whole[5] = whole.get(5, b"") + bytes(r["bytes"])
    assert whole[5].decode() == "é" * 3000 + "\r\n"


# --- 10 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(docs, texts, words, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, words, percent).collect()}
    assert got == brute.components(texts, words, percent)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), min_size=1, max_size=9))
def test_settle_connects_what_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]

    def groups(pairs):
        parent = list(range(len(sets)))

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in pairs:
            parent[find(a)] = find(b)
        return {frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert groups(jaccard_join.settle(arrays, range(len(arrays)), 80)) == groups(every)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {i: i for e in edges for i in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}


# --- shared parts ----------------------------------------------------------------------------


def test_buffer_words(texts):
    raw = [(t or "").encode() for _, t in texts]
    buf = tokens.Buffer(raw)
    for i, (_, t) in enumerate(texts):
        assert buf.words(buf.first[i], buf.first[i + 1]) == [w.encode() for w in brute.WORD.findall(t or "")]


def test_shared_keys(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(60) << 40 for _ in range(5)]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, ks array<long>").repartition(5)

    def emit(batches):
        for b in batches:
            for i, ks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield np.full(len(ks), i), np.array(ks, np.uint64)

    got = {r.doc_id: {k & (1 << 48) - 1 for k in r["keys"]} for r in shared_keys.shared_keys(df, emit, 7).collect()}
    owners = {}
    for i, ks in rows:
        for k in ks:
            owners.setdefault(shared_keys.fold(np.array([k], np.uint64), 7)[0], set()).add(i)
    want = {}
    for k, who in owners.items():
        if len(who) > 1:
            for i in who:
                want.setdefault(i, set()).add(int(k) & (1 << 48) - 1)
    assert got == want


def _sent_to_python(df):
    """Bytes that the plan's last Python node read, after collecting it."""
    node = df._jdf.queryExecution().executedPlan()
    while True:
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        elif node.nodeName().startswith("MapInArrow"):
            return node.metrics().apply("pythonDataSent").value()
        else:
            node = node.plan() if "QueryStage" in node.nodeName() else node.children().head()


def test_tables_of_buckets_are_sent_once(spark):
    rng = np.random.default_rng(3)
    held = [(i, 0, rng.integers(0, 1 << 62, 4000).tolist()) for i in range(8)]
    rows = [*held, *((8 + i, i % 3, held[i % 8][2][: 6 if i > 7 else None] + [5, 5]) for i in range(64))]
    want = {(i, p, h, 0) for i, p, k in rows[8:] for h, _, have in held if have[0] == k[0]} | {(i, p, 8, 0) for i, p, _ in rows[9:]}
    sent = []
    for tasks in (2, 32):
        df = spark.createDataFrame(rows, "doc_id long, part long, ks array<long>").repartition(tasks, "doc_id")

        def places(batches):
            for b in batches:
                for i, p, ks in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    yield np.full(len(ks), i), np.full(len(ks), p), np.array(ks, np.uint64)

        got = shared_keys.first_holders(df, places, 3)
        assert {tuple(r) for r in got.collect()} == want
        found = shared_keys.shared_keys(df, lambda batches: ((i, k) for i, _, k in places(batches)), 3)
        assert {r.doc_id for r in found.collect()} == {i for i, _, _ in rows}
        sent.append([_sent_to_python(x) for x in (got, found)])
    assert all(many < 2 * few for few, many in zip(*sent, strict=True)), sent


def test_long_windows_leave_chance_repeats(spark, monkeypatch):
    """Short runs of words that texts share by chance send none of them through the automata of 50-word windows."""
    rng = random.Random(6)
    plain = [[f"w{rng.randrange(9)}" for _ in range(300)] for _ in range(60)]
    rows = [*enumerate(" ".join(t) for t in plain), (60, " ".join(plain[7][100:160] + ["x"]))]
    went = []
    first_holders = substring_dedup.first_holders
    monkeypatch.setattr(substring_dedup, "first_holders", lambda words, *a: went.extend(r.doc_id for r in words.collect()) or first_holders(words, *a))
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_digest(frame(spark, rows), 50).collect()}
    assert {i: n for i, n in got.items() if n} == {60: 60}
    assert sorted(set(went)) == [7, 60]


def test_empty_tables(empty):
    assert substring_dedup.dedup_digest(empty).count() == 0
    assert licenses.license_scan(empty).count() == 0
    assert fingerprint.fingerprint_pairs(empty).count() == 0
    assert language_id.predict(empty, language_id.train(empty)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    same(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name])
