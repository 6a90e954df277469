"""Parts of the operators that need no cluster, against brute force."""

import random
import zlib

import numpy as np
import pytest

from lectern.llm import ann, binpack, ngram, simhash, sitetree, warc


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in [(0, 1), (1, 1), (5, 3), (1000, 10**9), (5000, 300), (64, 64)]:
        values = np.sort(rng.integers(0, top, n))
        packed, end = ngram.EliasFano.at(ngram.EliasFano.pack(values), 0)
        assert (packed[np.arange(n)] == values).all()
        asked = np.concatenate([rng.integers(0, 2 * top, 500), values])
        place, equal = packed.successor(asked)
        assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(1, 60, (900, 2)), axis=0)
    held, asked = pairs[::2], pairs
    p = rng.random(len(held))
    trie = ngram.Trie(ngram.Trie.pack(held[:, 0], held[:, 1], p))
    code = trie.code(asked[:, 0], asked[:, 1])
    assert ((code > 0) == (np.arange(len(asked)) % 2 == 0)).all()
    assert np.abs(np.log10(ngram.probability(code[::2])) - np.log10(p)).max() < 0.002
    assert (ngram.Trie(ngram.Trie.pack(held[:0, 0], held[:0, 1], p[:0])).code(asked[:, 0], asked[:, 1]) == 0).all()


def test_pair_of_close_fingerprints():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    i, j = (np.concatenate(x) for x in zip(*simhash.close_pairs(a, b, 3), strict=True))
    assert {(x, y) for x, y in zip(i, j, strict=True)} == {(x, y) for x in range(300) for y in range(300) if bin(int(a[x] ^ b[y])).count("1") <= 3}
    assert list(simhash.forest(np.array([1, 2, 5]), np.array([2, 3, 6]), 8)) == [0, 1, 1, 1, 4, 5, 5, 7]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One Two") == simhash.fingerprint("one  two")


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 50): rng.randint(1, 30) for _ in range(20)}
    used: dict[int, int] = {}
    bins = 0
    for repeats, lengths in binpack.patterns(counts, 50):
        assert sum(lengths) <= 50
        bins += repeats
        for x in lengths:
            used[x] = used.get(x, 0) + repeats
    assert used == counts
    room: list[int] = []  # first fit, longest first
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= x), None)
        if k is None:
            room.append(50 - x)
        else:
            room[k] -= x
    assert bins <= len(room) + 1


def test_first_bin_is_the_fullest():
    # 30 with 12 + 8 is full; the greedy choice of 15 would leave 5 empty.
    assert sorted(binpack.patterns({30: 1, 15: 1, 12: 1, 8: 1}, 50)[0][1]) == [8, 12, 30]


def test_graph_recall():
    x = np.random.default_rng(3).normal(size=(1500, 24))
    unit = ann._unit(x)
    graph, starts = ann.build_graph(unit, degree=24, beam=48)
    q = unit[:100]
    found, _ = ann.beam_search(unit, graph, q, starts, 64)
    exact = np.argsort(-(q @ unit.T), axis=1)[:, :6]
    recall = np.mean([len(set(f[:6]) & set(e)) / 6 for f, e in zip(found, exact, strict=True)])
    assert recall >= 0.95
    assert (graph < len(x)).sum(axis=1).max() <= 24


def test_warc_reader():
    pages = [(1, "http://a/\nb", b"x" * 200_000), (2, None, b""), (3, "http://c/", "é".encode() * 60), (None, "u", b"y")]
    data = b"".join(warc.record(p, u, x, warc.hashlib.sha256(x).hexdigest(), None, False) for p, u, x in pages)
    data += warc.record(4, "http://d/", pages[2][2], warc.hashlib.sha256(pages[2][2]).hexdigest(), 3, True)
    got = list(warc.read(data))
    assert [r["payload"] for r in got] == [x for _, _, x in pages] + [None]
    assert [r["page_id"] for r in got] == [1, 2, 3, None, 4]
    assert got[4]["type"] == "revisit" and got[4]["refers_to"] == 3 and got[4]["payload_bytes"] == 120 and got[0]["url"] == "http://a/%0Ab"
    assert len(list(warc.members(data))) == 5
    for broken in (data[:-5], data[:300] + b"\0\0" + data[302:]):
        with pytest.raises(warc.CorruptArchive):
            list(warc.read(broken))
    whole = warc.record(1, None, b"abc" * 50, "0" * 64, None, False)
    with pytest.raises(warc.CorruptArchive):
        list(warc.read(whole))
    assert zlib.decompressobj(31).decompress(whole).startswith(b"WARC/1.1\r\n")


def test_page_text():
    page = """<!DOCTYPE html><html><head><title>x</title></head><body class="has-sidebar"><header>site</header><nav>menu</nav><div class="ad">buy</div>
      <main><article><header><h1>T &amp; Q</h1></header><p>He<b>llo</b> w&ouml;rld<br>two<p>three <i>4</i></p><ul><li>a<li>b</ul>
      <section id="comments"><p>nice!</p></section><table><tr><td>1<td>2</table><script>var x="</p>";</script><p>1 < 2 &lt;b&gt;</p></article></main><footer>f</footer><!-- c"""
    assert sitetree.Page(page).text() == "T & Q Hello wörld two three 4 a b 1 2 1 < 2 <b>"
    assert sitetree.Page("").text() == "" and sitetree.Page("plain <b>x</b>y").text() == "plain xy"
    assert sitetree.Page("<p>a<div>b</div>c</p>d").text() == "a b c d"
    assert sitetree.Page("<form><div>in</div><article>a<button>b</button></article><aside><article>c</article></aside></form>").text() == "a"
    assert sitetree.Page('<div class="content with-sidebar">a<div class="left-sidebar">b</div></div>').text() == "a"
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert sitetree.Page(deep).text() == "text"
