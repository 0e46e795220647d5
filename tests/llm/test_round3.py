"""Prefix trie, BPE and ranked search against brute force and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hepark.llm import bpe, catalog, cgk, debruijn, linededup, minhash, mixing, ranked, template, toxicity, trie

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CONV = "conv_id long, turn int, role string, text string, depth int"
DOC = "doc_id long, text string, n int, score string"


# ------------------------------------------------------------------ trie

def brute_trie(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    member = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            member[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in member if k)
    leaves, saved = Counter(), Counter()
    for k, m in member.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in member.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(member[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations():
    rng = random.Random(4)
    rows = [(None, 1, "user", "nobody", 7), (3, None, None, None, 7), (3, None, "user", "x", 7), (8, 1, "a", "tie", 7),
            (8, 1, "a", "tie", 7), (8, 1, "b", "tie", 7), (-7, 1, "user", "negative", 7), (-5, 2, "user", "base", 7)]
    for c in range(10, 60):                             # copies that share beginnings
        rows += [(c, t, "user" if t % 2 else "bot", f"turn {t} {rng.choice('ab') if t > 2 else ''}", 7)
                 for t in range(rng.randint(1, 24))]
    for c in (100, 101, 105):                           # through all bands, two of them alike to turn 1500
        rows += [(c, t, "user", f"long {t if t < 1500 else (t, c)}", 7) for t in range(1600)]
    rows += [(c, t, "user", f"hot {t}", 7) for c in range(1000, 1700) for t in range(10)]
    return rows


def test_trie_brute_force(spark):
    rows = odd_conversations()
    got = trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_rounds(spark, monkeypatch):
    """Open chains are peeled in several rounds, ids come in several rows."""
    monkeypatch.setattr(trie, "LAST_CHAINS", 8)
    monkeypatch.setattr(trie, "ID_BITS", 2)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONV)).collect() == []


# ------------------------------------------------------------------ BPE

@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


ODD_TEXTS = ["", None, "a", "ΑΣ ΟΔΟΣ Σ", "İstanbul ẞ", "<|endoftext|>", "x<|startoftext|> y<|endoftext", "don't I'LL 'S",
             "aaaa" * 3000, "é é ​\x85\x1c\x00", "\U00010d50 ⅷ ꟍ 漢字かな한글 🙂🙂", "…—’s 　", " \n\t ",
             "".join(random.Random(2).choice("abcdefgh") for _ in range(30000)), "�힣՘₹"]


def test_bpe_equals_library(spark, word_bpe):
    path, lib = word_bpe
    rows = [(i, t, 0, "") for i, t in enumerate(ODD_TEXTS)] + [(None, "null id", 0, ""), (1, "again", 0, "")]
    rows += [(r.doc_id, r.text, 0, "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, DOC)
    got = bpe.decode(bpe.encode(df, path), path).collect()
    want = []
    for d, t, _, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, ids, lib.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == sorted(want, key=str)
    few = spark.createDataFrame(rows[:3], DOC)
    out = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(few, path), path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (out[0].n_tokens, out[0].ids_sha256, out[0].decoded_sha256) == (0, empty, empty)
    assert out[2].ids_sha256 == hashlib.sha256(b"320").hexdigest() and out[2].n_tokens == 1


def test_bpe_code_points(word_bpe):
    """Every code point of the own rule's range, and some beyond."""
    path, lib = word_bpe
    own = bpe.Bpe(open(path, "rb").read())
    points = [*range(0x3100), 0x4E00, 0x9FEF, 0x9FF0, 0xAC00, 0xD7A3, 0xD7A4, 0xA7DC, 0x10D50, 0x1F642]
    for at in range(0, len(points), 64):
        text = " ".join(f"A{chr(p)}b1 {chr(p)}" for p in points[at:at + 64])
        assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, hex(points[at])


def test_bpe_random_words(word_bpe):
    """Backtracking against merging by rank."""
    own = bpe.Bpe(open(word_bpe[0], "rb").read())
    rng = random.Random(7)
    pieces = [s for s in own.spelling.values() if all(ord(c) < 256 for c in s) and len(s) < 6]
    for _ in range(3000):
        spelt = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))[:-1] + chr(256 + rng.randint(97, 122))
        assert own.encode_word(spelt) == own.merge(spelt)


def test_bpe_byte_level_file(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD_TEXTS if t is None or len(t) < 20000]
    got = bpe.decode(bpe.encode(spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], DOC), path), path)
    for r in got.collect():
        assert r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.text == texts[r.doc_id]                # an exact round trip


def test_bpe_decode_odd(spark, word_bpe):
    rows = [(1, None), (2, []), (3, [320, None, 99999999, -1, 321]), (None, [49407, 0])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), word_bpe[0]).collect()
    names = {i: word_bpe[1].id_to_token(i) for i in (320, 321, 0)}
    want = [(1, ""), (2, ""), (3, f"{names[320]} {names[321]}"), (None, f"<|endoftext|> {names[0]}")]
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(want, key=str)
    assert bpe.encode(spark.createDataFrame([], DOC), word_bpe[0]).collect() == []


# ------------------------------------------------------------------ ranked search

def brute_search(docs, items, k):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    terms = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    n_docs, total = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        q, found = Counter(TERM.findall(low(text))), []
        for d, c, n in terms:
            m = 75 + (25 * n * n_docs) // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def odd_documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Café", "naïve", "X1"]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(63)], k=rng.randint(0, 40)))) for i in range(400)]
    docs += [(None, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "... !!"), (903, "w3 " * 20000),
             (904, "W3-w4_w5"), (905, "\x00w6\x7fw7")] + [(1000 + i, "same words w50 w51") for i in range(90)]
    items = [(1, "w1 w2 w40 w41 w42 w1"), (2, "w50 w51 Café"), (3, None), (4, "absent"), (5, ""), (None, "w3 w5 X1 naïve"),
             (1, "w0"), (6, docs[7][1] or "w1")]
    return docs, items


@pytest.mark.parametrize("block", [16, 4096])
def test_search_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    docs, items = odd_documents()
    got = ranked.search(spark.createDataFrame([(d, t, 1, "") for d, t in docs], DOC).repartition(3),
                        spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 20)


def test_search_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_BYTES", 20)
    docs, items = odd_documents()
    got = ranked.search(spark.createDataFrame([(d, t, 1, "") for d, t in docs], DOC),
                        spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 3)


def test_pair_bounds_skip():
    """Joint maxima skip postings that the terms' own maxima would not, and lose nothing."""
    rng = np.random.default_rng(1)
    n, weight = 2000, np.array([0, 900, 950, 5000], np.int64)
    has = [np.arange(n) % 2 == 0, np.arange(n) % 2 == 1, rng.random(n) < 0.05]   # terms 1 and 2 never meet
    doc, term = np.nonzero(np.stack(has, 1))
    tf = rng.integers(1, 9, len(doc))
    ptr = np.searchsorted(doc, np.arange(n + 1))
    import pyarrow as pa
    item, groups = Counter({1: 1, 2: 1, 3: 1}), [(1, 2), (3,)]

    def run(pairs):
        batch = ranked._block(pa.array(range(n)), np.full(n, 20), term + 1, tf, ptr, weight, pairs, n, 20 * n)
        block = ranked.opened({c: batch.column(i)[0].values for i, c in enumerate(ranked._NAMES)})
        best = ranked.Best(20)
        read = [ranked.score_block(block, item, groups, best, {(1, 2): 0}) for _ in range(2)]
        return best, read

    best, read = run([(1, 2)])
    assert read[0] == n and read[1] < n / 10            # then only the rare term's documents
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, ranked.impacts(tf, weight[term + 1], np.full(len(doc), 100)))
    assert best.score[0] == score.max()


def test_search_empty(spark):
    none, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.search(none, items).collect() == []
    assert ranked.search(spark.createDataFrame([(1, "w1", 1, "")], DOC), items.limit(0)).collect() == []


# ------------------------------------------------------------------ null and shared ids

def documents_without_ids():
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    lines = lambda tag, n: "\n".join(f"{tag} line {i}" for i in range(n))
    return [(1, words("a", 60)), (None, words("a", 60)), (None, "zz"), (None, words("b", 71)), (None, words("a", 30)),
            (2, words("a", 55) + " tail"), (3, words("c", 60)), (3, words("c", 52) + " other"), (None, words("b", 71)),
            (4, lines("p", 5)), (None, "x\n" + lines("p", 3) + "\ny"), (None, "one"), (None, None), (5, ""),
            (6, lines("q", 4)), (6, "top\n" + lines("q", 4)), (6, lines("q", 4))]


def ranks(spark, rows):
    """Rows in the order in which they count: doc_id, null last, then the texts' hashes."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "i int, text string")
    h = {r[0]: tuple(r[1:]) for r in df.select("i", F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")).collect()}
    return [(d is None, d or 0, *h[i]) for i, (d, _) in enumerate(rows)]


def brute_windows(rows, order, cut, size):
    """For each row the units that an earlier document's window covers."""
    first = {}
    units = [cut(t or "") for _, t in rows]
    for u, o in sorted(zip(units, order), key=lambda x: x[1]):
        for i in range(len(u) - size + 1):
            first.setdefault(tuple(u[i:i + size]), (o, i))
    gone = []
    for u, o in zip(units, order):
        gone.append({j for i in range(len(u) - size + 1) if first[tuple(u[i:i + size])][0] < o for j in range(i, i + size)})
    return units, gone


def test_substrings_null_and_shared_ids(spark):
    rows = documents_without_ids()
    units, gone = brute_windows(rows, ranks(spark, rows), lambda t: re.findall(r"[^ \n]+", t), 50)
    want = [(d, len(u), len(g), hashlib.sha256(" ".join(w for i, w in enumerate(u) if i not in g).encode()).hexdigest())
            for (d, _), u, g in zip(rows, units, gone)]
    df = spark.createDataFrame([(d, t, 1, "") for d, t in rows], DOC)
    assert sorted(map(tuple, debruijn.query(df).collect()), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 150
    texts = debruijn.dedup_substrings(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in texts if r.doc_id) == sorted(w[:3] for w in want if w[0])


def test_lines_null_and_shared_ids(spark):
    rows = documents_without_ids()
    order = ranks(spark, rows)
    lines = [[x for x in (t or "").split("\n") if x.strip()] for _, t in rows]
    first = {}
    keyed = lambda v: [(0, tuple(v), "all")] if 0 < len(v) < 3 else [(i, tuple(v[i:i + 3]), "") for i in range(len(v) - 2)]
    for v, o in sorted(zip(lines, order), key=lambda x: x[1]):
        for i, w, kind in keyed(v):
            first.setdefault((kind, w), (o, i))
    want = []
    for (d, _), v, o in zip(rows, lines, order):
        gone = {j for i, w, kind in keyed(v) if first[kind, w] < (o, i) for j in range(i, i + len(w))}
        want.append((d, len(v), len(gone)))
    got = linededup.query(spark.createDataFrame([(d, t, 1, "") for d, t in rows], DOC)).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_removed) for r in got], key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ pipeline

CLASH = "doc_id long, text string, lang string, source string, n_chars long, __id int, line_id int, LINE_TEXT string, mix_copies int"


def test_pipeline_stages_clashing_columns(spark):
    rows = [(d, t, "en", "s" if i % 3 else None, len(t or ""), 1, 2, "z", 3)
            for i, (d, t) in enumerate(documents_without_ids())]
    docs = spark.createDataFrame(rows, CLASH)
    cut = corpus_pipeline.dedup_lines(spark, docs, SF)
    assert cut.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in cut.collect()}
    assert (None, "x\ny") in kept and (None, "one") in kept and (None, None) in kept and (6, "top") in kept
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns and near.where("doc_id is null").count() == 8
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.where("coalesce(text, '') = ''").count() == 0
    empty = docs.limit(0)
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        after = out.collect()
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if not r.predicted}
            assert {r.doc_id for r in after} == want and len(want) < len(before)
        elif name == "line_dedup":
            cut = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
            assert {(r.doc_id, r.text) for r in after} == {(d, cut.get(d, r.text)) for d, r in before.items()
                                                          if cut.get(d) != ""}
        elif name == "near_duplicates":
            group = defaultdict(list)
            for r in minhash.near_duplicates(docs).collect():
                group[r.component_id].append(r.doc_id)
            assert {r.doc_id for r in after} == {min(g) for g in group.values()}
        elif name == "decontamination":
            bad = {r.doc_id for r in cgk.contaminations(docs, items).collect()}
            assert {r.doc_id for r in after} == set(before) - bad
        else:
            copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect() if r["size"]}
            assert Counter(r.doc_id for r in after) == Counter({d: c for d, c in copies.items() if c})
        if step < 4:
            assert out.columns == docs.columns
        docs = out


# ------------------------------------------------------------------ page templates

PAGE = "page_id long, url string, html string, host string, hash int"


def brute_templates(rows, least=5):
    """The text of each page with subtrees counted per host in plain Python."""
    parsed = [template.parse(h or "") for _, _, h in rows]
    hosts = [re.sub(r"^\w+://([^/?#]*).*", r"\1", u or "") if "://" in (u or "") else "" for _, u, _ in rows]
    seen = defaultdict(set)
    for host, (blocks, _, trees) in zip(hosts, parsed):
        for t, _, _ in trees:
            seen[host, t].add(tuple(blocks))
    out = []
    for (page, url, _), host, (blocks, content, trees) in zip(rows, hosts, parsed):
        gone = {i for t, a, b in trees if len(seen[host, t]) >= least for i in range(a, b)}
        text = " ".join(b for i, b in enumerate(blocks) if content[i] and i not in gone)
        out.append((page, url, text, len(text), len(gone)))
    return sorted(out, key=str)


def page_rows():
    rows = [(i, "http://one.example/p", f"<body><div class=top><a href=/>Home</a> Shop</div><nav>Menu</nav><article><h1>T{i}</h1>"
             f"<p>Same words.</p><div>Follow us</div><p>Own {i}</p></article><div>Legal text</div></body>") for i in range(7)]
    rows += [(100 + i, "http://two.example/", f"<div>Rare menu</div><p>Text {i}</p>") for i in range(4)]
    rows += [(200, "http://two.example/", "<div>Rare menu</div><p>Text 0</p>"), (None, None, None), (201, "x", ""),
             (202, None, "a &lt; b\u00a0 c"), (203, "http://one.example/", "<div>" * 3000 + "deep" + "</div>" * 10),
             (204, "http://one.example/", "<p>" + "long text " * 50000 + "</p>"), (0, "http://one.example/q", "<p>again")]
    return rows


def test_templates_brute_force(spark):
    rows = page_rows()
    got = template.extract_main_text(spark.createDataFrame([(*r, "h", 1) for r in rows], PAGE)).collect()
    assert sorted(map(tuple, got), key=str) == brute_templates(rows)
    text = {r.page_id: r for r in got}
    assert text[3].text == "T3 Same words. Own 3" and text[3].n_template >= 4
    assert text[101].text == "Rare menu Text 1" and text[202].text == "a < b c"
    assert template.extract_main_text(spark.createDataFrame([], PAGE)).collect() == []


def test_templates_are_counted_on_the_test_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_templates(rows)
    # every page offers subtrees; the tables' menus, adverts and footers differ from page to page
    assert min(len(template.parse(h or "")[2]) for _, _, h in rows) >= 3
    shop = [(i, u, (h or "").replace("<nav>", "<div class=top>Shop</div><nav>")) for i, u, h in rows]
    more = template.extract_main_text(spark.createDataFrame(shop, "page_id long, url string, html string")).collect()
    assert sorted(map(tuple, more), key=str) == brute_templates(shop) and sum(r.n_template for r in more) > 100
    assert {r.page_id: r.text for r in more} == {r.page_id: r.text for r in got}


@pytest.mark.parametrize("html,text", [
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title Body"),
    ('<article><header class="article-header"><h1>Title</h1></header><p>Body</p></article>', "Title Body"),
    ('<article><section id="related-work"><p>Work</p></section></article>', "Work"),
    ('<div class="notice-period"><p>Three months</p></div>', "Three months"),
    ('<div class="site-header">Site</div><div class="cookie-banner">Cookies</div><div class="comments-area"><p>Reader</p></div>'
     '<p>Body</p>', "Body"),
    ('<article><div class="header"><h1>T</h1></div><div id="comments">c</div><p>B</p></article>', "T B")])
def test_whole_class_names(spark, html, text):
    got = template.extract_main_text(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string"))
    assert got.first().text == text
