"""The operators' methods against brute force, and held-out accuracy."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import html_text, langid, licenses, packing, pii, secret_scan, simhash, topk
from tessera.llm.components import components
from tessera.sources.tables import read

SF = "/root/testdata/sf0.001"


def plain_links(fps, radius=2):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    return a, b


def classes(n, a, b):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def clustered(rng, n=3000):
    """Random fingerprints, a dense ball, and chains of small steps."""
    out = list(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    for center, spread in ((out[0], 3), (out[1], 6)):
        for _ in range(n // 3):
            x = int(center)
            for b in rng.choice(64, rng.integers(1, spread + 1), replace=False):
                x ^= 1 << int(b)
            out.append(np.uint64(x))
    x = int(out[2])
    for b in rng.permutation(64)[:40]:
        x ^= 1 << int(b)
        out.append(np.uint64(x))
    return np.unique(np.array(out, np.uint64))


def test_vantage_tree_finds_every_pair():
    rng = np.random.default_rng(1)
    fps = clustered(rng)
    tree, n = simhash.number_shards(simhash.build_tree(rng.choice(fps, 400, replace=False), len(fps) / 400, shard=40))
    assert n > 20
    rows, shard, home = simhash.visits(tree, fps, 2)
    assert sorted(rows[home]) == list(range(len(fps)))
    own = np.empty(len(fps), int)
    own[rows[home]] = shard[home]
    seen = set(zip(rows, shard))
    for a, b in zip(*plain_links(fps)):
        low, high = (a, b) if own[a] <= own[b] else (b, a)
        assert (low, own[high]) in seen


def test_split_shards_find_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_CELLS", 1000)
    fps = clustered(np.random.default_rng(2), 900)
    every = np.arange(len(fps))
    got = {(int(x), int(y)) for a, b in simhash.near_pairs(every, every, fps, 2) for x, y in zip(a, b)}
    assert got == {(int(x), int(y)) for x, y in zip(*plain_links(fps))}


def test_near_classes_match_brute_force(spark):
    fps = clustered(np.random.default_rng(3), 1500)
    prints = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    links = simhash.link_fingerprints(prints, shard=64)
    assert links.count() <= 40 * len(fps)
    got = {r.fp: r.component_id for r in simhash.near_classes(prints).collect()}
    root = classes(len(fps), *plain_links(fps))
    assert [got[int(f)] for f in fps.view(np.int64)] == root


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(4).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[1000] == got[1001] == 1000


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b, k in enumerate(ones) if 2 * k > len(grams))


@pytest.mark.parametrize("text", ["", " ", "A", "a b", "a b c", "x y z x y z x y z", "É\x1f\xa0a B\tc\x0bd\x1cE f", "a\x85b c d e"])
def test_simhash_of(text):
    assert simhash.simhash(text) == plain_simhash(text)


def test_simhash_on_table(spark):
    for r in read(spark, SF, "documents").limit(40).collect():
        assert simhash.simhash(r.text) == plain_simhash(r.text or "")


BASE2 = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
          "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, *m.span()) for k, p in BASE2.items() for m in re.finditer(p, text) if ok[k](m[0])]


def odd_texts(alphabet, n=400, size=60):
    rng = random.Random(5)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("text", [
    "mail a.b+c@x-y.co.uk, @b.c d@e f@g.h.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 x 4111-1111-1111-1112",
    "+1 (202) 555-0143. +12 +1234567", "é😀 a@b.de 😀 10.0.0.1"])
def test_pii_base(text):
    assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == plain_pii(text)


def test_pii_base_on_odd_texts():
    for text in odd_texts("0123456789 .-+()@ab") + odd_texts("04.- 1@a", 400):
        assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == plain_pii(text)


def test_pii_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert "iban" in kinds("pay DE89 3704 0044 0532 0130 00 now") and "iban" not in kinds("pay DE88 3704 0044 0532 0130 00 now")
    assert kinds("SSN: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert pii.redact("to a@b.de now") == "to <email> now"


def plain_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secret_scan.ASSIGN, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_base(spark):
    rng = random.Random(6)
    parts = ["token", "API_KEY", "Secret", "passwd", "=", ":", " ", "\"", "'", "é😀", "abcdefgh", "0" * 31, "f" * 33, "AKIA", "ABCDEFGHIJKL", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.find_secrets(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in secret_scan.BASE_KINDS] == plain_secrets(texts[r.doc_id])


def test_random_strings_are_found_and_text_is_not(spark):
    rng = random.Random(7)
    abc = secret_scan.ALPHABETS["base64"]
    secret = ["".join(rng.choice(abc[:62]) for _ in range(40)) for _ in range(100)]
    plain = ["Abcabcabc1Abcabcabc1Abcabcabc1Abcabcabc1", "ThisIsALongIdentifierNameVersion2Final", "AAAAAAAAAAAAAAAAAAAAaaaaaaaaaaaaaaaa1111"] * 30
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.find_secrets(df).collect() if any(s.kind == "random" for s in r.spans)}
    real = {i for i, t in enumerate(secret) if all(re.search(c, t) for c in ("[0-9]", "[a-z]", "[A-Z]"))}
    assert len(found & real) >= 0.9 * len(real) and not {i for i in found if i >= 100}


def test_licenses_match_brute_force(spark):
    rng = random.Random(8)
    filler = ["zeb", "qua", "the", "of", "software", "license"]
    texts = ["see Under  the-MIT license; cc BY nc. CC by Nc x", "apache license version 2 under the mit licenses", ""]
    for t in licenses.TEMPLATES:
        words = t.text.split()
        for part in (0.75, 0.85, 1.0):
            kept = words[:math.ceil(part * len(words))]
            pad = [rng.choice(filler) for _ in range(rng.randint(0, 400))]
            texts.append(" ".join(pad + kept + pad[:90]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].lower())
        places, labels = [], set()
        for p, label in licenses.PHRASES.items():
            q = p.split()
            at = [i for i in range(len(w)) if w[i:i + len(q)] == q]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == \
            (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
        for s in range(0, max(1, len(w)), 128):
            block, best = set(w[s:s + 256]), {}
            for n, t in enumerate(licenses.TEMPLATES):
                want = set(licenses.tokens_of(t.text))
                if len(want & block) >= 0.8 * len(want) and set(t.required) <= block:
                    match = (len(want & block), len(want & block) / len(want), t.label)
                    best[t.family or n] = max(match, best.get(t.family or n, match))
            labels |= {m[2] for m in best.values()}
        assert r.labels == sorted(labels)


def test_licenses_of_one_family(spark):
    """Every notice in running text gets its own label only; so do other wordings and neighbours."""
    texts = [(t.label, f"copyright 2020 the authors {t.text} and so on with the rest of the file") for t in licenses.TEMPLATES]
    texts += [("cc-by", "This work is licensed under a Creative Commons Attribution 3.0 International License"),
              ("cc-by-sa", "this article is licensed under a creative commons attribution sharealike 4.0 international license"),
              ("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
                       "as published by the Free Software Foundation, either version 3, or any later version of the License"),
              ("", "This work is licensed under a plain international license 4.0 by its author with attribution"),
              ("", "redistribute the general public software under terms of a foundation as published by any program")]
    both = licenses.TEMPLATES[0].text + " " + licenses.TEMPLATES[5].text
    texts.append(("lgpl,mit", both))
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: ",".join(r.labels) for r in licenses.scan_licenses(df).collect()}
    assert [got[k] for k in range(len(texts))] == [w for w, _ in texts]


def test_forward_sums_all_segmentations():
    pieces = [langid.START, langid.START + "a", "a", "b", "ab", "aba", langid.START + "ab"]
    keys = langid._hash_pieces(pieces)
    order = np.argsort(keys)
    rng = np.random.default_rng(9)
    probs = np.vstack([rng.random((len(pieces), 2)), [[langid.FLOOR] * 2]])
    words = ["ab", "aba", "abab", "a", "bca"]
    got = langid.Lattice(words, keys[order], order).forward(probs)[1]
    table = {p: probs[i] for i, p in enumerate(pieces)}

    def total(s):
        if not s:
            return np.ones(2)
        out = sum((table[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in table), np.zeros(2))
        return out if s[0] in table else out + langid.FLOOR * total(s[1:])
    assert np.allclose(got, np.log([total(langid.START + w) for w in words]))


def test_long_words_are_summed_whole(monkeypatch):
    rng = np.random.default_rng(7)
    pieces = [langid.START, langid.START + "a", "a", "b", "ab", "aba", "ba" * 8, langid.START + "ab"]
    keys = langid._hash_pieces(pieces)
    order = np.argsort(keys)
    probs = np.vstack([rng.random((len(pieces), 2)), [[langid.FLOOR] * 2]])
    logs = langid.log_probs({"langs": ["x", "y"], "probs": probs})
    words = ["a", "zab", "abab", "ba" * 30, "".join(rng.choice(list("abz"), 25)), "".join(rng.choice(list("ab"), 150))]
    want = langid.Lattice(words, keys[order], order).forward(probs)[1]
    for step in (langid.STEP, 7):
        monkeypatch.setattr(langid, "STEP", step)
        assert np.allclose([langid.long_word(w, keys[order], order, logs) for w in words], want)
    monkeypatch.undo()
    # letters that no piece has cost a floor each, however many: no underflow
    got = langid.long_word("z" * 100_000, keys[order], order, logs)
    assert np.allclose(got, np.log(probs[0]) + 100_000 * np.log(langid.FLOOR))


def test_language_of_text_without_spaces(spark):
    docs = read(spark, SF, "documents").where("text is not null and lang is not null")
    model = langid.fit(docs)
    joined = docs.where(langid.held_out()).select("doc_id", "lang", F.regexp_replace("text", r"[\W\d_]+", "").alias("text")) \
        .where(F.length("text") > 200)
    got = langid.predict(joined, model).collect()
    assert len(got) > 20 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9


def test_language_held_out(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    texts = ["", "The cat, THE CAT!", "it's we're 'll 2024 3.14", "ÉCOLE İstanbul ΣΑΣ K é a b\x1cc", "x" * 300, "a<|endoftext|>b",
             "日本語 テスト 😀!!", "end. (par) \"q\" a.b.c |x| ÑLL!! d'où", "　tab\tnew\nline \x85 z"]
    for x in texts:
        for cache_words in (packing.CACHE_WORDS, 4):
            got = np.frombuffer(packing.encode_texts([x], path, cache_words)[0], "<u4").tolist()
            assert got == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(10).integers(1, 90, 500)
    seq, off = packing.best_fit(lengths, 100, max_docs=5, max_cost=6000.0, rule=rule)
    for s in np.unique(seq):
        own = lengths[seq == s]
        assert own.sum() <= 100 and len(own) <= 5 and (own.sum() == own[0] or (own.astype(float) ** 2).sum() <= 6000) or len(own) == 1
        o = np.argsort(off[seq == s])
        assert (np.cumsum(own[o]) - own[o] == off[seq == s][o]).all()


def test_best_fit_is_tight():
    lengths = np.random.default_rng(11).integers(50, 2500, 3000)
    seq, _ = packing.best_fit(lengths, 4096)
    assert len(np.unique(seq)) <= math.ceil(lengths.sum() / 4096) * 1.02


@pytest.mark.parametrize("blocks, pilot", [(1, 8192), (3, 40), (2, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, blocks, pilot):
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    monkeypatch.setattr(topk, "CHUNK", 60)
    vectors = read(spark, SF, "embeddings")
    size = sum(len(r.embedding) for r in vectors.where("vec_id % 50 = 0 and embedding is not null").collect()) * 8
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(
        vectors, F.col("vec_id") % 50 == 0, k=7, query_bytes=-(-size // blocks), pilot_rows=pilot).collect())
    rows = vectors.collect()
    q = {r.vec_id: [math.floor(1024 * float(x)) for x in r.embedding] for r in rows}
    want = []
    for i in sorted(q):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:7]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == want


def test_shared_bounds_save_products():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    c = np.floor(256 * (centres[rng.integers(40, size=4000)] + 0.3 * rng.normal(size=(4000, 64)))).T
    q, k = c[:, :50], 10
    rest_q, rest_c = topk.remaining(q, topk.DIMS), topk.remaining(c, topk.DIMS)
    open_, spent = topk.search_columns(q, rest_q, c, rest_c, k, np.full(50, -np.inf))
    scores = q.T @ c
    shared = -np.partition(-scores[:, ::2], k - 1, axis=1)[:, k - 1]      # bounds of half the candidates
    got, less = topk.search_columns(q, rest_q, c, rest_c, k, shared)
    assert less < spent < scores.size * 64
    for j in range(50):
        want = np.sort(scores[j])[::-1][:k]
        for at, score in (open_[j], got[j]):
            assert np.array_equal(np.sort(score)[::-1][:k], want) and np.array_equal(scores[j, at], score)


def test_lstm_gradients():
    rng = np.random.default_rng(12)
    x, mask = rng.normal(size=(4, 3, 2)), np.ones((4, 3, 1))
    mask[2:, 1] = 0
    w, b = rng.normal(size=(2 + 3, 12)) * 0.3, rng.normal(size=12) * 0.1
    up = rng.normal(size=(4, 3, 3))
    loss = lambda w, b: (html_text.lstm_forward(x, mask, w, b)[0] * up).sum()
    gw, gb = html_text.lstm_backward(x, mask, w, html_text.lstm_forward(x, mask, w, b)[1], up)
    for i, j in itertools.product(range(5), range(0, 12, 5)):
        d = np.zeros_like(w)
        d[i, j] = 1e-5
        assert abs((loss(w + d, b) - loss(w - d, b)) / 2e-5 - gw[i, j]) < 1e-6
    d = np.zeros(12)
    d[7] = 1e-5
    assert abs((loss(w, b + d) - loss(w, b - d)) / 2e-5 - gb[7]) < 1e-6


def test_html_leaves_boilerplate_out():
    model = html_text.fit([])
    page = ("<html><head><title>t</title><style>x{}</style></head><body><header>Site</header><div class='cookie-notice'>We use cookies</div>"
            "<main><h1>T&eacute;st</h1><p>One <a href=x>two</a>&nbsp; three<p>four<!-- no --><aside>side</aside><div class=ad>buy</div>"
            "<script>var a='<p>no</p>';</script><form>Mail<button>go</button></form><section id='user-comments'><p>nice</p></section></main>"
            "<footer>f</footer></body></html>")
    assert html_text.texts(model, [page]) == ["Tést\nOne two three\nfour"]


def test_labeller_agrees_with_held_out_paths(spark):
    pages = [r.html for r in read(spark, SF, "pages").collect()]
    model = html_text.fit(pages[:25])
    for p in pages[25:]:
        blocks = html_text.blocks_of(p)
        x, mask = html_text.padded([html_text.vectors(blocks, {})])
        assert ((html_text.label(model, x, mask)[0][:, 0] > 0.5) == (html_text.teacher(blocks) > 0.5)).all()


SENTENCES = "Some words of the text that are read by people on this page, all of them. " * 3
REMARKS = "<article class=comment><p>I like it</p></article><article class=comment><p>Me too, thanks</p></article>"


@pytest.fixture(scope="module")
def html_model(spark):
    return html_text.fit([r.html for r in read(spark, SF, "pages").limit(25).collect()])


@pytest.mark.parametrize("page", [
    "<div class='content-sidebar-wrap'><article>{}</article><div class=sidebar>no</div></div>",
    "<div class='has-sidebar'><div class=entry>{}</div></div>",
    "<div id='page' class='header-fixed'><main>{}</main><footer>no</footer></div>",
    "<form id='aspnetForm'><nav>no</nav><div class=content>{}</div></form>",
    "<article><header><h1>T</h1></header>{}</article>",
    "<article>{}<section id='related-work'><h2>Related work</h2><p>{}</section><section id=search><p>{}</section></article>",
])
def test_html_keeps_the_text_under_wrappers_and_open_names(html_model, page):
    page = "<html><body><header>Site</header>" + page.replace("{}", "<h1>T</h1><p>" + SENTENCES, 1).replace("{}", SENTENCES) + "</body></html>"
    page = page.replace("<h1>T</h1></header><h1>T</h1>", "<h1>T</h1></header>")
    want = ["T", "Related work"] if "related-work" in page else ["T"]
    got = html_text.texts(html_model, [page])[0].split("\n")
    assert [g for g in got if g != SENTENCES.strip()] == want and got.count(SENTENCES.strip()) == page.count(SENTENCES)


@pytest.mark.parametrize("page", [
    "<div class='entry-content'>{}</div><div id=comments>" + REMARKS + "</div>",
    "<div class='entry-content'>{}</div>" + REMARKS,
    "<article>{}</article><div class=continued><p>" + SENTENCES + "</div>",
])
def test_html_labeller_decides_outside_articles(html_model, page):
    page = "<html><body><nav>Site</nav>" + page.replace("{}", "<h1>T</h1><p>" + SENTENCES) + "<footer>f</footer></body></html>"
    assert html_text.texts(html_model, [page]) == ["\n".join(["T", *[SENTENCES.strip()] * page.count(SENTENCES)])]


def test_pii_finds_each_of_several_accounts():
    a, b = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    found = lambda text: [text[s:e] for k, s, e, _ in pii.spans_of(text) if k == "iban"]
    assert found(f"{a} {b}") == [a, b] and found(f"{b} {a} {a}") == [b, a, a]
    assert found(f"AB12 REF 7 {a}") == [a] and found(f"DE11 CODE ORDER {b}") == [b]
    assert found(f"{a}0 X{a}") == []


def test_secrets_in_one_case_and_dashed_hex(spark):
    rng = random.Random(8)
    some = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    low, up = secret_scan.ALPHABETS["base36"], secret_scan.ALPHABETS["base36"].upper()
    keys = [f(x) for x in range(20) for f in (
        lambda _: "z1" + some(low, 30), lambda _: "Z8" + some(up, 30),
        lambda _: "a1" + "-".join(some("0123456789abcdef", n) for n in (6, 4, 4, 4, 12)))]
    words = ["abababababababababababab12" * 2, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa9z", "0000-0000-0000-0000-0000-0000-000a"]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(keys + words)], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.find_secrets(df).collect() if any(s.kind == "random" for s in r.spans)}
    assert len(found & set(range(60))) >= 55 and not found & set(range(60, 63))


def test_secrets_long_token_takes_linear_time(spark):
    token = "".join(random.Random(9).choice(secret_scan.ALPHABETS["base64"]) for _ in range(100_000))
    df = spark.createDataFrame([(token, "base64")], "value string, encoding string")
    start = time.time()
    assert 0 < secret_scan.randomness(df).first()["p"] <= 1 and time.time() - start < 30


def test_best_fit_prefers_the_exact_fit():
    seq, _ = packing.best_fit(np.array([3900] + [200] * 20 + [96]), 4096)
    assert seq[-1] == seq[1] != seq[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_get_the_tokenizers_ids(name):
    """Also of a cased tokenizer that reads white space with its words."""
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(name)
    texts = ["", "The house, THE HOUSE!  and\tits\u00a0tree;", "Stra\u00dfe, \u00c4pfel. \u039f\u0394\u039f\u03a3, \u039f\u0394\u039f\u03a3 e\u0301, \u0301x don't, it's|x 12, 3.4 a1, --, <|endoftext|>,",
             "a\x1cb \x1d, c\x85d"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.encode_texts(texts, path)] == want


def test_shards_leave_no_part_filled_sequences(spark):
    """Short pieces, few sequences a shard: at most 1% over the lower bound."""
    rng = np.random.default_rng(6)
    lengths = rng.integers(5, 41, 20000)
    loose = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "rid long, length long")
    rows = packing.placed_pieces(loose, 4096, 1000, {}).collect()
    assert sorted(r.rid for r in rows) == list(range(len(lengths)))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, int(lengths[r.rid])))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by) <= 1.01 * -(-lengths.sum() // 4096)


def test_norm_needs_no_more_than_plain_best_fit():
    rng = np.random.default_rng(7)
    for draw in (lambda: rng.integers(5, 41, 3000), lambda: rng.integers(50, 2500, 1500), lambda: rng.integers(1, 4096, 800)):
        n = draw()
        plain: list[int] = []
        for x in sorted(n.tolist(), reverse=True):
            fit = [i for i, free in enumerate(plain) if free >= x]
            if fit:
                plain[min(fit, key=plain.__getitem__)] -= x
            else:
                plain.append(4096 - x)
        assert packing.best_fit(n)[0].max() + 1 <= len(plain)


NAMES = ["HttpServletRequest2Wrapper", "getUserProfileById2Async", "org/apache/spark/sql/Dataset2", "AbstractSingletonProxyFactoryBean3",
         "usr/local/lib/python3/dist-packages", "MAX_RETRY_COUNT_PER_HOST_2024", "application_config_v2_staging",
         "com/example/project1/Module2Test", "ThreadPoolTaskExecutor4Bean", "internal-load-balancer-eu-west-1",
         "InvoiceNumber20240101Draft", "my-long-kubernetes-pod-name-7", "kafka-topic-orders-v2-retry-dlq",
         "Sha256WithRSAEncryptionOid", "TestCase12345ForLongNames", "src/main/resources/Config3", "Utf8StringDecoderFactoryImpl",
         "customerAddressLine2Validator", "Route53HostedZoneConfiguration", "docs/release-notes/version-3-chapter-2"]


def test_names_are_no_secrets_but_keys_are(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice(secret_scan.ALPHABETS["base64"][:62]) for _ in range(n)) for n in (20, 24, 32, 40) for _ in range(30)]
    df = spark.createDataFrame([(i, f"x {v} y") for i, v in enumerate(NAMES + keys)], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.find_secrets(df).collect() if any(s.kind == "random" for s in r.spans)}
    assert len([i for i in found if i < len(NAMES)]) <= 1 and len([i for i in found if i >= len(NAMES)]) >= 110


def test_name_p_and_cut_against_plain_sums(spark):
    rng = random.Random(4)
    values = NAMES + ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in range(20, 60)]
    df = spark.createDataFrame([(v, "base64" if v in NAMES else "hex") for v in values], "value string, encoding string")
    got = {r.value: r.q for r in secret_scan.name_p(df).collect()}

    def kind(c):
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    for v in values:
        bits, last = 0.0, None
        for c in v:
            k = kind(c)
            bits -= math.log2(secret_scan.FIRST[k] if last is None else secret_scan.NEXT[last][k])
            share = secret_scan.LETTERS[ord(c.lower()) - 97] / sum(secret_scan.LETTERS) if k < 2 else .1 if k == 2 else 1 / secret_scan.MARKS
            bits, last = bits - math.log2(share), k
        want = min(1.0, 2 ** (len(v) * (6 if v in NAMES else 4) - bits))
        assert math.isclose(got[v], want, rel_tol=1e-9)
    # the step-up: rejected are the k smallest with the largest k whose p is at most fdr k / m
    p = sorted(rng.choice((rng.random(), 10 ** -rng.uniform(0, 6))) for _ in range(200))
    bins = [min(3000, math.floor(-100 * math.log10(x))) for x in p]
    k = max((i for i, b in enumerate(bins, 1) if 10 ** (-b / 100) <= .05 * sum(x >= b for x in bins) / 200), default=0)
    cands = spark.createDataFrame([("hex", 0, b) for b in bins], "encoding string, band int, bin int")
    cut = secret_scan.discovered_from(cands).first()["cut"]
    assert k and sum(b >= cut for b in bins) == sum(b >= bins[k - 1] for b in bins)


def test_many_matches_in_one_text_take_little_time(spark):
    rng = random.Random(5)
    token = ["".join(rng.choice(secret_scan.ALPHABETS["base64"][:62]) for _ in range(24)) for _ in range(60_000)]
    text = " \u00e9 ".join(f"token={x}" if i % 2 else x for i, x in enumerate(token))
    start = time.time()
    spans = secret_scan.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert time.time() - start < 60 and len(spans) > 55_000
    assert all(text[s.start:s.end] == s.value for s in spans[::997])


LINE = "This is a sentence of running text that goes on for a good while, with some commas, and then ends"


@pytest.mark.parametrize("page, want", [
    ("<article><h1>T</h1>" + "".join(f"<div class='elementor-widget elementor-widget-text-editor'><p>{LINE} {i}</p></div>" for i in range(5))
     + "</article>", ["T", *[f"{LINE} {i}" for i in range(5)]]),
    (f"<article><h1>T</h1><p>{LINE}.</p><section id=banner-towns><p>{LINE} two.</p></section></article>", ["T", f"{LINE}.", f"{LINE} two."]),
    (f"<article><h1>T</h1><p>{LINE}.</p><div hidden><p>{LINE} three.</p></div><div style='display:none'><p>{LINE} four.</p></div></article>",
     ["T", f"{LINE}.", f"{LINE} three.", f"{LINE} four."]),
    (f"<article><h1>T</h1><p>The first half <svg><path d='x'/><text>no</text></svg> and the second, {LINE}</p>"
     f"<p>Press <button>start</button> to begin<script>var x</script>, {LINE}</p></article>",
     ["T", f"The first half and the second, {LINE}", f"Press start to begin, {LINE}"])])
def test_html_keeps_article_text(html_model, page, want):
    page = f"<html><body><nav><a href=x>Home</a></nav>{page}<footer>Imprint</footer></body></html>"
    assert html_text.texts(html_model, [page])[0].split("\n") == want


def test_html_lines_go_on_over_inline_elements():
    text = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert text("<p>a <select><option>x<option>y</select> b <input type=text> c<style>p{}</style></p>d") == ["a b c", "d"]
    assert text("<p>a<svg><svg/><g/></svg>b <canvas>no</canvas>c") == ["ab c"]
    assert html_text.blocks_of("<div><button>Share</button> <label>this</label></div>")[0].path[-1][0] == "button"
