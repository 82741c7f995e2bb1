"""Operators 2, 3, 6, 7 and 9 against brute force, round trips and held-out accuracy."""

import base64
import itertools
import math
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import bpe, decontam, langid, queries, secrets, tokencount
from chronoframe.llm.common import mix, read

from .conftest import SF


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 7: byte-level BPE ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_keep_ids(plain):
    texts = ["a b" * 50, "x\n\n  y z's  'll foo 12 34!? ", " lead  two   three\t tab nbsp em end ", "no-blank" * 40,
             "é è 日本 語 ́ x" * 9, "a \n b \r\n c" * 7]
    for t in texts:
        for size in (1, 2, 3, 7, 50):
            cut = list(bpe.pieces(t, size))
            assert "".join(cut) == t
            assert [i for p in cut for i in plain.encode_ordinary(p)] == plain.encode_ordinary(t)


def test_round_trip(spark, docs, odd, empty, plain):
    for df in (docs, odd):
        rows = bpe.decode(bpe.encode(df)).collect()
        both = bpe.encode(df, decoded=True)
        assert sorted(map(repr, both.collect())) == sorted(map(repr, rows))
        want = sorted(((r["doc_id"], plain.encode_ordinary(r["text"] or ""), (r["text"] or "").encode())
                       for r in df.select("doc_id", "text").collect()), key=repr)
        got = sorted(((r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), bytes(r["decoded"])) for r in rows), key=repr)
        assert got == want
        assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert bpe.encode(empty).collect() == []


# --- 2: unigram token counts -----------------------------------------------------------------
def best_count(word, scores, byte):
    """Plain dynamic program over one word, without a trie."""
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        options = [(best[j - 1][0] + n * byte, best[j - 1][1] - n)]
        options += [(best[i][0] + scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_trie_counts(spark, odd, empty, docs):
    scores = tokencount.load_scores(tokencount.default_pieces())
    byte = -math.log(len(scores) + 2)
    known = {}
    for df in (odd, docs.orderBy("doc_id").limit(40)):
        for r in tokencount.count_tokens(df).join(
                df.selectExpr("doc_id as d", "text as t", "n_chars").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect():
            words = re.findall(r"\S+", r["t"] or "")
            for w in words:
                if w not in known:
                    known[w] = best_count(tokencount.MARK + w, scores, byte)
            assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))
            assert r["n_bytes"] == len((r["t"] or "").encode())
    assert tokencount.count_tokens(empty).collect() == []


def test_trie_restart(monkeypatch):
    scores = {"▁": -1.0, "a": -2.0, "ab": -2.5, "b": -2.0}
    trie = tokencount.PrefixTrie(scores)
    trie.add(["ab", "abab", "b"])
    first = dict(trie.counts)
    monkeypatch.setattr(tokencount, "MAX_KEPT", 0)
    trie.add(["abab", "ab", "b"])
    assert trie.counts == first == {"ab": 2, "abab": 3, "b": 2}


# --- 3: secrets ------------------------------------------------------------------------------
def brute_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text,
                         re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


SECRETS = [
    (1, "secret=token:abcdefgh and Api_Key='ABCDEF123' paſsword=abcdefgh"),
    (2, "é AKIA" + "A" * 16 + " AKIAB AKIA" + "0" * 15 + " deadbeefdeadbeefdeadbeef01"),
    (3, "login: Tr0ub4dor&3xK9#qLzW!7 pwd is hunter2hunter2 auth = !!!!!!!!!!!!!!!!"),
    (4, "token = " + "ab12" * 5000), (5, None), (6, ""), (6, ""), (None, "password: s3cr3tvalue99"),
]


def test_base_spans(spark, docs):
    df = spark.createDataFrame(SECRETS, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as id")
    for table in (df, docs):
        texts = {(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()}
        by_id = dict(texts)
        for r in secrets.scan(table).collect():
            base = brute_spans(by_id[r["doc_id"]] or "")
            assert r["base_spans"] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
            kept = [x for x in r["spans"].split(",") if x and not x.startswith("guess")]
            assert kept == [x for x in r["base_spans"].split(",") if x]
    assert secrets.scan(df.limit(0)).collect() == []


def test_guess_cost_order():
    words = secrets.load_words(secrets.default_words())
    longest = max(map(len, words))

    def bits(v):
        return secrets.guess_bits(v, words, longest)

    assert bits("password") < bits("p4ssword") < bits("xq7#Lm2$") and bits("aaaaaaaaaaaaaaaa") < bits("aqzmwnsxbe")
    assert bits("qwertyuiop") < bits("qpwoeiruty") and bits("2019-05-17") < bits("8361-52-94")
    assert bits("correcthorsebattery") < bits("cxrrkcthqrsxbzttfry")


def test_random_short_values():
    """Random values in wider contexts: nearly all from 8 characters on, most of 6 and 7."""
    words = secrets.load_words(secrets.default_words())
    longest = max(map(len, words))

    def found(text):
        return any(k == 3 for _, k, _ in secrets.scan_text(text, words, longest, secrets.MIN_BITS)[0])

    assert found("pwd=aB3xK9qL") and found("login: q7Zt2Xw") and found("auth: 8361529407") and not found("login: monkey")
    rng = random.Random(4)
    for n, least in ((6, 190), (7, 195), (8, 198), (9, 198), (10, 198)):
        values = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for _ in range(200)]
        hits = sum(found(f"see pwd={v} there") for v in values)
        assert hits >= least, (n, hits)


def test_contexts_and_repeats(spark):
    words = secrets.load_words(secrets.default_words())
    longest = max(map(len, words))

    def found(text):
        return [text[s:e] for s, k, e in secrets.scan_text(text, words, longest, secrets.MIN_BITS)[0] if k == 3]

    v = "q7Zt2XwPl9KfR4sVb8Nm"
    assert found(f"Authorization: Bearer {v}\nnext") == [v] and found(f"curl -H 'bearer {v}'") == [v]
    assert found(f"postgres://bob:{v[:10]}@db/x and http://a/b") == [v[:10]]
    assert found(f"auth: login: {v[:10]}") == [v[:10]] and found(f"password: token: {v[:10]}") == [v[:10]]
    assert found("login: hunter2hunter2 auth: xkq7xkq7xkq7xkq7 login: abcabcabcabcabc") == []
    assert found("the bearer certificate; a basic understanding; see https://host:8080/path@x") == []

    def bits(value):
        return secrets.guess_bits(value, words, longest)

    assert bits("xkq7" * 4) < bits("xkq7") + 8 and bits("abcabcabcabcabc") < 20 and bits("xkq7" * 4) < secrets.MIN_BITS
    assert secrets.block_repeats("ababab")[5] == [(2, 2)] and secrets.block_repeats("") == []
    text = "é " * 600_000 + f"\npwd={v}"
    df = spark.createDataFrame([(1, text, 1, "x"), (2, None, 1, "x")], "doc_id long, text string, n_assign long, base_spans string")
    rows = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert rows[1]["spans"] == f"guess:{len(text) - len(v)}:{len(text)}" and rows[2]["spans"] == ""
    assert secrets.redact(df).columns == df.columns


def test_many_lines_of_one_text():
    """Linear in the text: base spans and context values go along together."""
    words = secrets.load_words(secrets.default_words())
    longest = max(map(len, words))
    line = "password=q7Zt2XwPl9Kf\n"
    began = time.perf_counter()
    spans, _ = secrets.scan_text(line * 4000, words, longest, secrets.MIN_BITS)
    one = time.perf_counter() - began
    assert [k for _, k, _ in spans] == [0] * 4000
    began = time.perf_counter()
    assert len(secrets.scan_text(line * 16000, words, longest, secrets.MIN_BITS)[0]) == 16000
    assert time.perf_counter() - began < 8 * one + 1


def brute_bits(value, words):
    """All segmentations of a short value into words, dates, walks, repeats and single characters."""
    same, walk = secrets.run_lengths(value)
    best = {(0, False): 0.0}
    for i in range(len(value)):
        for brute in (False, True):
            if (i, brute) not in best:
                continue
            c = best[i, brute]
            step = c + math.log2(secrets.alphabet(value[i])) + (0 if brute else secrets.SEGMENT_BITS)
            key = (i + 1, True)
            best[key] = min(best.get(key, math.inf), step)
            for j in range(i + 3, len(value) + 1):
                cost = []
                if value[i:j] in words:
                    cost.append(math.log2(words[value[i:j]] + 1))
                if same[j - 1] == j - i:
                    cost.append(math.log2(secrets.alphabet(value[i])) + math.log2(j - i))
                if walk[j - 1] == j - i:
                    cost.append(math.log2(94) + math.log2(j - i))
                for x in cost:
                    key = (j, False)
                    best[key] = min(best.get(key, math.inf), c + x + secrets.SEGMENT_BITS)
    return min(best.get((len(value), b), math.inf) for b in (False, True))


def test_guess_cost_is_least():
    words = {"horse": 5, "bat": 9, "battery": 20, "red": 3}
    for v in ("horsebattery", "xhorsexx", "aaaaqwerty", "redredzq", "zzbatzz"):
        assert secrets.guess_bits(v, words, 7) <= brute_bits(v, words) + 1.0 + 1e-9


def test_context_spans_and_redaction(spark):
    df = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in SECRETS], "doc_id long, text string, lang string, n_chars long")
    scanned = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert scanned[3]["n_guess"] == 1 and "guess:7:" in scanned[3]["spans"]
    out = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert secrets.redact(df).schema == df.schema
    assert out[4]["text"] == "[SECRET]" and out[4]["n_chars"] == 8 and out[5]["text"] is None and out[6]["text"] == ""
    assert "Tr0ub4dor" not in out[3]["text"] and "[SECRET]" in out[None]["text"]
    again = secrets.scan(secrets.redact(df)).collect()
    assert all(r["spans"] == "" for r in again if r["doc_id"] != 1)


# --- 9: language ID ------------------------------------------------------------------------------
def plain_viterbi(scores, switch):
    n, k = scores.shape
    value, back = scores[0].astype(float), []
    for t in range(1, n):
        stay = value[:, None] - switch * (1 - np.eye(k))
        back.append(stay.argmax(axis=0))
        value = stay.max(axis=0) + scores[t]
    return value.max()


def path_value(scores, path, switch):
    return sum(scores[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_viterbi_is_best():
    rng = np.random.default_rng(2)
    counts = np.array([0, 5, 1, 17, 0, 3])
    scores = rng.normal(0, 3, (counts.sum(), 3)).astype(np.float32)
    label = langid.viterbi(scores, counts, 2.0)
    at = 0
    for n in counts:
        if n:
            part = scores[at:at + n].astype(float)
            assert path_value(part, label[at:at + n].tolist(), 2.0) == pytest.approx(plain_viterbi(part, 2.0), abs=1e-4)
        at += n


def test_viterbi_in_blocks(monkeypatch):
    """Pieces and blocks of any size give a best path."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(langid, "BLOCK", 5)
    for n, k in ((1, 3), (4, 2), (23, 3), (200, 4)):
        scores = rng.integers(-9, 0, (n, k)).astype(np.float32) + rng.random((n, k)).astype(np.float32)
        want = plain_viterbi(scores.astype(float), 4.0)
        for cells in (1 << 20, k * k * 2):
            monkeypatch.setattr(langid, "CELLS", cells)
            best, counts = langid.transfer(scores, 4.0)
            assert counts.sum() == n
            values = langid._forward(best, np.zeros(k))[-1]
            assert values.max() == pytest.approx(want, abs=1e-4)
            label, _ = langid._backward(scores, best, counts, np.zeros(k), int(values.argmax()), 4.0)
            assert path_value(scores.astype(float), label.tolist(), 4.0) == pytest.approx(want, abs=1e-4)


def test_long_texts(spark, docs, monkeypatch):
    """A long text in pieces has the spans that it has at once."""
    model = langid.learn(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) between 400 and 900").orderBy("doc_id").collect()}
    text = "\n".join([by["en"], by["fr"], "12 34 !!", by["en"]] * 3)
    w = langid.Words([text])
    want = langid.viterbi(model.word_scores(w), w.counts)
    for size in (50, 333, len(text)):
        start, end, label = langid.label_long(text, model, size=size)
        assert (start.tolist(), end.tolist(), label.tolist()) == (w.starts.tolist(), w.ends.tolist(), want.tolist())
    assert langid.pieces("a" * 25, 10) == [(0, 20), (20, 25)] and len(langid.label_long("1 2 " * 50, model, size=20)[0]) == 0
    table = spark.createDataFrame([(1, text), (2, "x"), (3, text * 400), (4, None)], "doc_id long, text string")
    assert len(text) * 400 > 2 * langid.LONG
    rows = {r["row"]["doc_id"]: r for r in langid.predict(table, model).collect()}
    n = len(rows[1]["spans"])
    assert rows[3]["lang_pred"] == rows[1]["lang_pred"] and abs(rows[3]["score"] - rows[1]["score"]) < 0.01
    assert 300 * n < len(rows[3]["spans"]) <= 400 * n and rows[4]["lang_pred"] == "und"


def test_language_against_brute_force(spark, docs):
    """Model and labels, recomputed word by word from the counts of trigrams and scripts."""
    learned = docs.where(~queries.held_out(F.col("doc_id")))
    model = langid.learn(learned)
    assert learned.groupBy("lang").count().where(f"count > {langid.PER_LANG}").count() == 0  # the sample is all of them
    grams, scripts = {x: Counter() for x in model.langs}, {x: Counter() for x in model.langs}

    def words(text):
        low = text.lower() if len(text.lower()) == len(text) else text
        return ["".join(g) for is_letter, g in itertools.groupby(low, str.isalpha) if is_letter]

    def buckets(word):
        at = [0, *map(ord, word), 0]
        key = np.array([at[i] << 42 | at[i + 1] << 21 | at[i + 2] for i in range(len(word))], np.uint64)
        with np.errstate(over="ignore"):
            return (mix(key) % np.uint64(langid.BUCKETS)).tolist()

    def script(ch):
        return next(name for first, name in reversed(langid.SCRIPTS) if ord(ch) >= first)

    for r in learned.where("lang is not null and text is not null").collect():
        for w in words(r["text"]):
            grams[r["lang"]].update(buckets(w))
            scripts[r["lang"]][script(w[0])] += len(w)

    def score(word, lang):
        total = sum(grams[lang].values()) + langid.SMOOTH * langid.BUCKETS
        own = [x for x in model.langs if scripts[x][script(word[0])] >= langid.SCRIPT_SHARE * max(1, sum(scripts[x].values()))]
        return sum(math.log((grams[lang][b] + langid.SMOOTH) / total) for b in buckets(word)) - (1e4 if own and lang not in own else 0)

    found = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    for r in docs.where("length(text) < 400").orderBy("doc_id").limit(25).collect():
        ws = words(r["text"] or "")
        if not ws:
            assert found[r["doc_id"]]["lang_pred"] == "und"
            continue
        scores = np.array([[score(w, x) for x in model.langs] for w in ws])
        back, value = [], scores[0]
        for row in scores[1:]:
            options = value[:, None] - langid.SWITCH * (1 - np.eye(len(value)))
            back.append(options.argmax(axis=0))
            value = options.max(axis=0) + row
        path = [int(value.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        letters = Counter()
        for w, j in zip(ws, reversed(path), strict=True):
            letters[model.langs[j]] += len(w)
        best = max(sorted(letters), key=letters.get)
        assert found[r["doc_id"]]["lang_pred"] == best
        assert found[r["doc_id"]]["score"] == pytest.approx(letters[best] / sum(letters.values()), abs=1e-6)


def test_language_accuracy_and_contract(spark):
    found = queries.op9_language_id(spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows_and_spans(spark, docs, odd, empty):
    model = langid.learn(docs)
    got = langid.predict(odd, model)
    assert got.select("row.*").schema == odd.schema or got.select("row.*").columns == odd.columns
    rows = [(r["row"]["doc_id"], r["lang_pred"], r["score"], len(r["spans"])) for r in got.collect()]
    none = [r for r in rows if r[0] in (1, 2, 3, 10)]
    assert none and all(r[1:] == ("und", 0.0, 0) for r in none) and len(rows) == odd.count()
    assert langid.predict(empty, model).collect() == []
    assert {r["lang_pred"] for r in langid.predict(odd, langid.learn(empty)).collect()} == {"und"}
    by = {r["lang"]: r["text"] for r in docs.where("length(text) between 400 and 900").orderBy("doc_id").collect()}
    en, fr = by["en"], by["fr"]
    mixed = spark.createDataFrame([(1, en + "\n" + fr)], "doc_id long, text string")
    spans = langid.predict(mixed, model).first()["spans"]
    cover = sum(min(s["end"], len(en)) - s["start"] for s in spans if s["lang"] == "en" and s["start"] < len(en))
    assert cover > 0.8 * len(en) and any(s["lang"] == "fr" and s["end"] > len(en) for s in spans)


def test_script_narrows():
    w = langid.Words(["Жук beetle"])
    m = langid.Model(["en", "ru"], np.zeros((2, langid.BUCKETS), np.float32), np.zeros((len(langid._NAMES), 2), bool))
    m.own[langid._NAMES.index("Latin"), 0] = m.own[langid._NAMES.index("Cyrillic"), 1] = True
    assert m.word_scores(w).argmax(axis=1).tolist() == [1, 0]


# --- 6: decontamination -----------------------------------------------------------------------------
ITEM = "If Alice buys 12 apples for 3 dollars each and then sells 12 pears to the market how much money is left"
ITEMS = [(1, ITEM), (2, "five little words are here"), (3, "tiny one"), (4, None), (5, "")]


def leaked(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 as h", "0 as item_id")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, items, **options).collect()}


def test_reparameterised_questions(spark):
    changed = ITEM.replace("Alice", "Bob").replace("12", "45").replace("3 dollars", "7 euros")
    uneven = ITEM.replace("12 apples", "45 apples")
    texts = ["Before. " + ITEM + ". after", "xx " + changed.replace(" ", "\n"), "so " + uneven + " end", None, "",
             "clean words about nothing at all with no market here", "yes five little words are here now", "tiny one",
             "Before. " + ITEM.upper()[:10]]
    for options in ({}, {"max_hashes": 0}):
        got = leaked(spark, texts, **options)
        assert set(got) == {(0, 1), (1, 1), (2, 1), (6, 2), (7, 3)}
        assert got[0, 1]["n_changed"] == 0 and got[1, 1]["n_changed"] >= 3


def test_whole_passages(spark, docs):
    """Every document that contains an item verbatim is found, and no other."""
    items = read(spark, SF, "benchmark").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items
            if i["text"] and d["text"] and " ".join(i["text"].split()) in " ".join(d["text"].split())}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_decontamination(spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 2
    left = decontam.clean(docs, read(spark, SF, "benchmark"))
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, odd.where("doc_id = 6").first()["text"])], "item_id long, text string")
    got = tuples(decontam.leaks(odd, items).select("doc_id"))
    assert got == sorted([(6,), (7,), (8,), (None,)], key=repr)
    assert decontam.leaks(empty, items).collect() == [] and decontam.leaks(odd, items.limit(0)).collect() == []
    assert decontam.clean(odd, items).where("doc_id in (6, 7, 8) or doc_id is null").count() == 0


def plain_words(text):
    """(word in lower case, kind, begins a sentence) of an ASCII text: L literal, # number, N name, U unit."""
    out, end = [], 0
    for m in re.finditer(r"(?:[A-Za-z0-9]|(?<=[0-9])[.,](?=[0-9]))+", text):
        new = not out or bool(re.search(r"[.!?:;\n\r]", text[end:m.start()]))
        word, end = m[0], m.end()
        if re.search(r"\d", word):
            kind = "#"
        elif out and out[-1][1] == "#" and word.lower() in decontam.UNITS:
            kind = "U"
        else:
            kind = "N" if word[0].isupper() and not new else "L"
        out.append((word.lower(), kind, new))
    return out


def plain_windows(words, size):
    """(place, key, slots) of the windows of both kinds."""
    for at in range(len(words) - size + 1):
        w = words[at:at + size]
        if size < decontam.MIN_WORDS:
            if w[0][2] and (at + size == len(words) or words[at + size][2]):
                yield at, ("whole", *(x[0] for x in w)), [x[0] for x in w if x[1] in "#U"]
            continue
        least = min(size, decontam.MIN_LITERALS)
        if sum(x[1] == "L" for x in w) >= least:
            yield at, ("names", *(x[0] if x[1] == "L" else x[1] for x in w)), [x[0] for x in w if x[1] != "L"]
        slots = [x[0] for x in w if x[1] in "#U"]
        if sum(x[1] in "LN" for x in w) >= least:
            yield at, ("plain", *(x[0] if x[1] in "LN" else x[1] for x in w)), slots
        else:
            yield at, ("exact", *(x[0] for x in w)), slots


def plain_leaks(docs, items):
    out = {}
    for d, text in docs:
        words = plain_words(text)
        for i, item in items:
            theirs = plain_words(item)
            size = min(len(theirs), decontam.WINDOW)
            if not size:
                continue
            by = {}
            for at, key, slots in plain_windows(theirs, size):
                by.setdefault(key, []).append((at, slots))
            shifts = {}
            for at, key, slots in plain_windows(words, size):
                for place, own in by.get(key, ()):
                    shifts.setdefault(at - place, set()).add((place, tuple(zip(own, slots, strict=True))))
            covered, places, n_slots, n_changed = set(), set(), 0, 0
            for windows in shifts.values():
                votes = Counter(p for _, pairs in windows for p in set(pairs))
                chosen = {}
                for (a, b), n in votes.items():
                    chosen[a] = max(chosen.get(a, (0, False, "")), (n, a == b, b))
                fine = [(p, pairs) for p, pairs in windows if all(chosen[a][2] == b for a, b in pairs)]
                kept = {x for _, pairs in fine for x in pairs}
                if fine:
                    places |= {p for p, _ in fine}
                    covered |= {p + k for p, _ in fine for k in range(size)}
                    n_slots, n_changed = max(n_slots, len(kept)), max(n_changed, sum(a != b for a, b in kept))
            if covered and len(covered) >= min(decontam.COVER_WORDS, math.ceil(len(theirs) * decontam.COVER_SHARE)):
                out[d, i] = (len(places), len(covered), len(theirs), n_slots, n_changed)
    return out


def test_decontamination_against_brute_force(spark):
    """Random questions, copied, cut, re-parameterised and shouted, against plain Python, all columns."""
    rng = random.Random(11)
    names, units = ["Alice", "Bob", "Carol", "Dan"], ["kg", "km", "dollars", "cents"]
    verbs = ["buys", "sells", "drops", "paints", "finds", "counts", "eats"]

    def question():
        parts = [f"{rng.choice(names)} {rng.choice(verbs)} {rng.randrange(40)} {rng.choice(units)} of {rng.choice(['rice', 'wool', 'sand'])}"
                 for _ in range(rng.randrange(1, 4))]
        return rng.choice(["If ", "", "So "]) + " and then ".join(parts) + rng.choice(["", "? How much is left", ". What now"])

    items = [(i, question()) for i in range(25)] + [(25, "Two plus two"), (26, "12"), (27, ""), (28, "What is 12 plus 30?")]
    docs = []
    for d in range(120):
        text = rng.choice(items)[1]
        how = rng.randrange(5)
        if how == 1:
            text = re.sub(r"\d+", lambda m: str(rng.randrange(40)), text)
        elif how == 2:
            text = text.replace(rng.choice(names), rng.choice(names))
        elif how == 3:
            text = rng.choice([str.upper, str.lower, str.title])(text)
        elif how == 4:
            text = " ".join(text.split()[rng.randrange(4):][:rng.randrange(5, 20)])
        docs.append((d, rng.choice(["", "well. ", "and so it goes, ", "x\n"]) + text + rng.choice(["", ". Next one", " and on"]) + " " + rng.choice(["", question()])))
    want = plain_leaks(docs, items)
    columns = ["doc_id", "item_id", "n_windows", "n_covered", "n_words", "n_slots", "n_changed"]
    assert len(want) > 60 and any(v[4] for v in want.values())
    for options in ({}, {"max_hashes": 0}):
        got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
        rows = {(r[0], r[1]): tuple(r[2:]) for r in got.select(*columns).collect()}
        assert rows == want


def test_short_items_are_whole_sentences(spark):
    items = [(1, "What is two plus"), (2, "Name three primary colours."), (3, "Paris"), (4, "12 + 30")]
    texts = ["Q: What is two plus?", "what is two plus", "I ask what is two plus", "What is two plus two?", "so\nname three PRIMARY colours\nok",
             "name three primary colours and more", "paris", "we saw paris", "12 30", "12 31", "What is. two plus"]
    for options in ({}, {"max_hashes": 0}):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(0, 1), (1, 1), (4, 2), (6, 3), (8, 4), (10, 1)}


def test_clean_by_text(spark):
    """Of the texts under one id, or under none, only those that leak go."""
    docs = spark.createDataFrame([(5, "so. " + ITEM), (5, "clean words"), (None, "so. " + ITEM), (None, "clean too"), (6, None)],
                                 "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert tuples(decontam.clean(docs, items)) == sorted([(5, "clean words"), (None, "clean too"), (6, None)], key=repr)


def test_consistency_per_window(spark):
    """A place that differs costs its windows only; new values may coincide; texts under one id don't mix."""
    uneven = ITEM.replace("12 apples", "45 apples")
    equal = ITEM.replace("12", "4").replace("3 dollars", "4 dollars")
    other = ITEM.replace("Alice", "Carol").replace("12", "77")
    texts = [(0, "so. " + uneven + " end"), (1, "so. " + equal + " end"), (2, "so. " + ITEM), (2, "so. " + other),
             (None, "so. " + ITEM), (None, "so. " + other), (3, "so. " + " ".join(ITEM.split()[:9]) + " and no more")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.leaks(docs, items).collect()}
    assert set(got) == {0, 1, 2, None}
    assert got[0]["n_covered"] == 18 and got[1]["n_covered"] == got[2]["n_covered"] == 22


def test_case_numbers_and_scripts(spark):
    """Copies in other case, items of names and numbers, and scripts without blanks."""
    han = "小明有十二个苹果，他又买了三个，现在一共有多少个苹果？"
    thai = "แมวตัวนี้ชอบกินปลาทุกวันและนอนหลับใต้ต้นไม้ใหญ่"
    russian = "Сколько стоит билет если Анна купила пять билетов вчера"
    items = [(1, ITEM), (2, "What is 12 plus 30?"), (3, "The Old Man And The Sea By Ernest Hemingway In 1952"),
             (4, han), (5, thai), (6, russian)]
    texts = ["xx. " + ITEM.upper() + ". yy", "xx " + ITEM.title(), "xx. " + ITEM.upper().replace("12", "99"),
             "so: what is 12 plus 30? and", "so: what is 12 plus 31? and", "the old man and the sea by ernest hemingway in 1952",
             "前文。" + han + "后文", "其他的文字和苹果没有任何关系，只是一些词语而已", "คำ" + thai + "ครับ", "วันนี้อากาศดีมากเราไปเดินเล่นกัน",
             russian.upper(), ITEM.lower()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"max_hashes": 0}):
        got = {(r["doc_id"], r["item_id"]) for r in
               decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **options).collect()}
        assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (5, 3), (6, 4), (8, 5), (10, 6), (11, 1)}
