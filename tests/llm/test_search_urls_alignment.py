"""Lexical search, URL rules and token alignment against brute force, with odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricepanel.llm import alignment, lexical, url_rules

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_search(docs, items, top=10):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(d, split(t)) for d, t in docs]
    held = [(d, x, Counter(x)) for d, x in held if x]
    n_docs, length = len(held), sum(len(x) for _, x, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(split(t))
    out = []
    for i, wanted in terms.items():
        rows = []
        for d, x, c in held:
            m = 10 + (90 * len(x) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                rows.append((score, d))
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        out += [(i, k + 1, d, s) for k, (s, d) in enumerate(rows[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [lexical.BLOCK, 40])
def test_search_matches_brute_force(spark, block):
    rnd = random.Random(4)
    words = [*"alpha Beta gamma naïve Ünder x1 2 42 zeta_eta a-b ÄB".split(), "\u00a0", "日本", "e\u0301", "tail"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "\t", "--", "\x00", ""]) for _ in range(n))
    docs = [(k, text(rnd.randrange(40))) for k in range(120)] + [(200, None), (201, ""), (202, " ,;"), (None, "alpha beta"), (203, "alpha " * 30000)]
    docs += [docs[3]] * 3 + [(300 + k, "gamma gamma tail") for k in range(30)]  # repeated rows, and ties beyond the results
    items = [(k, text(6)) for k in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (3, "tail"), (None, "gamma"), (60, "alpha")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, df int")
    found = lexical.search(df, asked, block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_search(docs, items)


def test_search_without_rows(spark):
    empty_docs, empty_items = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([], "item_id int, text string")
    some = spark.createDataFrame([("a", "one two"), ("b", "one")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "one"), (2, "two")], "item_id int, text string")
    assert lexical.search(empty_docs, items).count() == lexical.search(some, empty_items).count() == 0
    assert sorted(tuple(r)[:3] for r in lexical.search(some, items).collect()) == [(1, 1, "b"), (1, 2, "a"), (2, 1, "a")]


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return max(fits)[3:] if fits else (None, None)


def split_url(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules_match_brute_force(spark):
    rnd = random.Random(8)
    hosts = ["a.net", "net", "EXAMPLE.net", "x.example.net", "notexample.net", "example.com", "www.Example.com", "b.org", "org", "xorg", "example.net:80", "ünï.org", ""]
    paths = ["", "/", "/en/1", "/en", "/de/x#y", "/fr/?q=://z", "?a/en/", "#t", "/de/\n2"]
    urls = [f"{rnd.choice(['http', 'https', ''])}{rnd.choice(['://', '://', ':', ''])}{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(300)] + [None, "", "://", "x://y://z/en/"]
    df = spark.createDataFrame([(k, u, "<p>", "clash") for k, u in enumerate(urls)] + [(0, urls[0], "<p>", "again")], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(url_rules.RULES, "domain string, prefix string, verdict string")
    found = url_rules.judge(df, rules).collect()
    assert len(found) == len(urls) + 1
    for r in found:
        host, path = split_url(urls[r.page_id])
        rule, verdict = brute_rule(host, path, url_rules.RULES)
        assert (r.host, r.path, r.rule, r.verdict, r.alias_verdict) == (host, path, rule, verdict or "allow", None), urls[r.page_id]
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(df, rules.limit(0)).collect()} == {"allow"}


def canonical(to):
    return f'<!doctype html><html><head><title>a < b</title><link href="{to}" rel="shortlink canonical"></head><body>'


def test_verdicts_reach_aliases(spark):
    pages = [
        (1, "https://bad.net/page", "<html>"),
        (2, "http://mirror.io/page", canonical("https://bad.net/page#top")),
        (3, "http://mirror.io/copy?x=1", canonical("/page")),
        (4, "http://deep.io/", '<meta HTTP-EQUIV=Refresh content="0; URL=\'http://mirror.io/copy?x=1\'">'),
        (5, "http://x.example.net/en/ok", canonical("http://bad.net/page2")),
        (6, "http://two.io/q", canonical("http://bad.net/page2")),
        (7, "http://three.io/comment", '<!-- <link rel=canonical href="https://bad.net/page"> --><body><link rel=canonical href="https://bad.net/page">'),
        (8, "http://three.io/script", '<script>"<link rel=canonical href=https://bad.net/page>"</script></head><link rel=canonical href="https://bad.net/page">'),
        (9, "http://four.io/based", '<base href="https://bad.net/"><link rel="canonical" href="page">'),
        (10, "HTTP://MIRROR.IO:80/page", None),
        (11, "http://logged.io/a", ""),
        (12, "http://alone.io/", canonical("http://fine.io/")),
        (13, "http://x.org/fr/allowed", canonical("https://bad.net/page")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame(url_rules.RULES, "domain string, prefix string, verdict string")
    log = spark.createDataFrame([("http://logged.io/a", "http://two.io/q"), ("http://logged.io/a", None), (None, "http://two.io/q")], "url string, target string")
    got = {r.page_id: (r.rule, r.verdict, r.alias_verdict) for r in url_rules.judge(df, rules, log).collect()}
    assert got[1][:2] == ("net/", "block")
    # the component of 1 holds an explicit allow (13), so aliases without a rule of their own are allowed
    assert {k: got[k][1] for k in (2, 3, 4, 9, 10)} == dict.fromkeys((2, 3, 4, 9, 10), "allow")
    without = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(df.where("page_id <> 13"), rules, log).collect()}
    assert {k: without[k] for k in (2, 3, 4, 9, 10)} == dict.fromkeys((2, 3, 4, 9, 10), (None, "block"))
    assert got[5][1] == got[6][1] == got[11][1] == "allow"  # 5 is allowed by a rule, and so are its aliases
    assert without[7] == without[8] == without[12] == (None, "allow")
    blocked = {r.page_id: r.verdict for r in url_rules.judge(df.where("page_id not in (5, 13)"), rules, log).collect()}
    assert blocked[6] == blocked[11] == "block"


def test_a_third_of_all_pages_name_one(spark):
    n = 3000
    df = spark.range(n).selectExpr("id AS page_id", "concat('http://h', id, '.io/') AS url", "if(id % 3 = 0, '<link rel=canonical href=\"http://bad.net/\">', '') AS html")
    rules = spark.createDataFrame(url_rules.RULES, "domain string, prefix string, verdict string")
    got = {r.page_id: r.verdict for r in url_rules.judge(df, rules).collect()}
    assert len(got) == n and all((v == "block") == (k % 3 == 0) for k, v in got.items())


def test_heads_take_linear_time():
    for page in ("<!" * 500_000, "<link " * 300_000, '<meta content="' * 300_000, "<!-- " * 300_000, " " * 2_000_000 + "<p>", "<title>" * 300_000, '<meta http-equiv=refresh content="' + " " * 1_000_000 + 'x">'):
        url_rules.head_links(page, "http://a.io/")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_align(text, a, b):
    """Ids of both and their groups, from whole texts."""
    if not text:
        return [], [], []
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    if not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
        return [], [], []
    groups, x, y, end_a, end_b = [], 0, 0, np.cumsum([len(p) for p in bytes_a]).tolist(), np.cumsum([len(p) for p in bytes_b]).tolist()
    for end in sorted(set(end_a) & set(end_b)):
        i, j = end_a.index(end) + 1, end_b.index(end) + 1
        groups.append((ids_a[x:i], ids_b[y:j]))
        x, y = i, j
    return ids_a, ids_b, groups


ODD_TEXTS = ["", " ", "  ", "   a", "a  b ", "a \n b\n\n  c", "x\t y", "<|endoftext|> a<|endoftext|>", "<s> </s> <unk><0x41>", "▁a ▁", "é e\u0301 日本語 \U0001f600 \U0001f468\u200d\U0001f469", "\u00a0 x\u3000 y", "1234567 0x7f 3.14", "don't I'll 's", "…  — “q” £ 5", "\u2581", "=" * 300, " " * 500 + "z", "\ufb01 \u2460", "ab\x00 c\x85 d\x1c e", "zz" * 3000]


def test_tokens_and_groups_match_whole_encodings(aligner, whole):
    rnd = random.Random(2)
    signs = [*"abcXYZ 019.,'-\n\t", "  ", "é", "日", "😀", "\u0301", "\u00a0", "…", " the", " ing", "▁", "<s>", "\r\n"]
    texts = ODD_TEXTS + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(300)]
    for turn in (texts, texts[::-1]):  # the second time from the memo
        got, at = aligner.align(turn), 0
        for k, t in enumerate(turn):
            ids_a, ids_b, groups = brute_align(t, *whole)
            links = Counter(i << 32 | j for x, y in groups for i in x for j in y)
            assert (got["n_a"][k], got["n_b"][k], got["n_groups"][k], got["n_links"][k]) == (len(ids_a), len(ids_b), len(groups), sum(links.values())), repr(t)
            written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert got["digests"][k] == (hashlib.sha256(written.encode()).hexdigest() if written else "")
            n = got["n_pairs"][k]
            assert dict(zip(got["pairs"][at : at + n].tolist(), got["times"][at : at + n].tolist(), strict=True)) == dict(links)
            at += n


def test_settled_characters_take_the_fast_way_to_the_same_ids(aligner):
    a = aligner.a.tokenizer
    assert a.fast is not None
    rnd = random.Random(11)
    settled = [chr(c) for c in range(0x250)]
    texts = [f" {x}{y}" for x in settled for y in ("a", "1", ".", " ", "\n", "'s", "\xa0")] + [f"a{x}b 1{x}2 .{x}. {x} {x}" for x in settled]
    texts += ["".join(rnd.choice(settled if rnd.random() < 0.5 else "aeinrst '\n0") for _ in range(rnd.randrange(1, 80))) for _ in range(3000)]
    texts += ["<|endoftext|>", " x<|endoftext|>", "日本 a", "é" * 300]
    assert a.encode(texts) == [e.ids for e in a.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from("abc")), max_size=120))
def test_run_skipping_finds_every_common_end(steps):
    """Each byte run ends a token of a, of b or of both; the last one of both."""
    a, b, at = [], [], 0
    for k, (n, kind) in enumerate(steps):
        at += n
        kind = "c" if k == len(steps) - 1 or k % 50 > 20 else kind  # long one-to-one stretches too
        if kind in "ac":
            a.append(at)
        if kind in "bc":
            b.append(at)
    ends_a, ends_b = alignment.common_ends(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in ends_a] == common and [b[j - 1] for j in ends_b] == common


def test_wide_groups_count_links(aligner):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 3, 250)
    of, ends_a, ends_b = np.array([0, 1]), np.array([100, 300]), np.array([120, 250])
    text, pairs, times = alignment.linked_pairs(of, a, b, ends_a, ends_b)
    links = Counter((k, int(i) << 32 | int(j)) for k, (x, y) in enumerate([(slice(0, 100), slice(0, 120)), (slice(100, 300), slice(120, 250))]) for i in a[x] for j in b[y])
    assert dict(zip(zip(text.tolist(), pairs.tolist(), strict=True), times.tolist(), strict=True)) == dict(links)


def test_alignment_counts_match_brute_force(spark, whole, monkeypatch):
    rnd = random.Random(6)
    words = "the quick don't tokenization unbelievable 12345 naïve 日本 antidisestablishment \n \t x,y".split(" ")
    texts = ODD_TEXTS + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))) for _ in range(60)] + [None]
    rows = [(k, t, 7) for k, t in enumerate(texts)] + [(30, texts[30], 7), (None, "the quick", 7)]
    found = [brute_align(t, *whole) for _, t, _ in rows]
    links = [Counter((i, j) for x, y in groups for i in x for j in y) for _, _, groups in found]
    counts = Counter(p for c in links for p in c)
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    expected = sorted(((r[0], len(a), len(b), len(g), sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items())) for r, (a, b, g), c in zip(rows, found, links, strict=True)), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)
    monkeypatch.setattr(alignment, "BLOCK", 400)
    monkeypatch.setattr(alignment, "CHUNK", 100)
    got = alignment.align(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((tuple(r)[:7] for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum").collect()), key=repr) == expected
    assert alignment.align(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_no_row_holds_a_block(spark, tmp_path, monkeypatch):
    """What a block leaves are rows of a document or a pair each, so that a task's batches don't grow with its blocks."""
    written = []
    keep = alignment.materialize
    monkeypatch.setattr(alignment, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    text = "the quick don't tokenization unbelievable 12345"
    df = spark.range(300).selectExpr("id AS doc_id", f'concat("{text} ", id) AS text').coalesce(1)
    got = alignment.align(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.where("n_links > 0 AND n_best <= n_links AND count_sum >= n_links").count() == 300
    nested = [f.name for f in written[0].schema if f.dataType.typeName() == "array"]
    assert nested
    most = max(max(len(r[c] or []) for c in nested) for r in written[0].collect())
    assert most <= got.agg({"n_links": "max"}).first()[0]
