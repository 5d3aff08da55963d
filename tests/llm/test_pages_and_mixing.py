"""Archives, HTML, mixing and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlark.llm import html_text, mixing, sharding, warc
from gridlark.llm.queries import DOMAINS, SHARES


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\nWARC/1.1\r\n\r\ny\n", "é😀" * 5000, "<p>a</p>", "last\n", "HTTP/1.1 200 OK\r\nX-Key: 5\r\n\r\n"]
    rows = [(i, None if i == 1 else f"http://h/{i} with blank ", h, 1) for i, h in enumerate(html)]
    rows += [rows[7], (None, "u", "keyless", 1), (None, "u", "<p>a</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key long")
    got = warc.archived(df).collect()
    assert len(got) == len(rows)
    want = []
    for h in {h or "" for _, _, h, _ in rows}:
        same = sorted((k for k, _, x, _ in rows if (x or "") == h), key=lambda k: (k is not None, k))
        want += [(k, len(h.encode()), b32(h), "response" if i == len(same) - 1 else "revisit", None if i == len(same) - 1 else same[-1]) for i, k in enumerate(same)]
    key = lambda r: str(r)
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    stored_ids = {r.record_id: r.payload_digest for r in got if r.record_type == "response"}
    assert all(stored_ids[r.refers_to_id] == r.payload_digest for r in got if r.record_type == "revisit")
    assert warc.archived(df.filter("false")).count() == 0


def test_warc_files_are_members_chunks_and_resources(spark, tmp_path, monkeypatch):
    """Blocks without an HTTP header, without keys, and with half a header; every record a gzip member; files capped."""
    blocks = [b"hello", b"hello", b"HTTP/1.0 200 OK\nX: y\n\nbody", b"HTTP/1.0 204", b"", b"body", random.Random(1).randbytes(3_000_000), b"\x00" * 20_000_000]
    content = warc.arc_head(1, "z.arc")
    for i, b in enumerate(blocks):
        content += f"dns:{i} 1.1.1.1 19970305 text/dns {len(b)}\n".encode() + b + b"\n"
    files = spark.createDataFrame([("z.arc", content)], warc.ARC_SCHEMA)
    out = str(tmp_path / "out")
    warc.convert(files, out)
    got = {int(r.url[4:]): r for r in warc.read_back(spark, out).collect()}
    assert [got[i].record_type for i in range(8)] == ["revisit", "resource", "revisit", "revisit", "resource", "resource", "resource", "resource"]
    assert got[0].refers_to_id == got[1].record_id and got[2].refers_to_id == got[5].record_id and got[2].refers_to is None
    assert [got[i].payload_bytes for i in range(8)] == [5, 5, 4, 0, 0, 4, 3_000_000, 20_000_000]
    parts = [p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))]
    records = 0
    for data in parts:
        whole = list(warc.parse_warc(gzip.GzipFile(fileobj=io.BytesIO(data))))
        assert whole[0][0]["WARC-Type"] == "warcinfo"
        at = 0  # members one by one, as a reader that seeks does
        while at < len(data):
            one = zlib.decompressobj(31)
            text = one.decompress(data[at:])
            records += text.startswith(b"WARC/1.1")
            at = len(data) - len(one.unused_data)
        assert at == len(data)
    assert records >= 9


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parses_declared_lengths(version):
    name = "a.arc"
    content = warc.arc_head(version, name)
    bodies = [b"x\n\nhttp://u 1.1.1.1 2 t 3\n", b"", "é".encode() * 9]
    for i, b in enumerate(bodies):
        content += warc.arc_record(version, f"http://h/{i}", i, b, name, len(content))
    found = list(warc.parse_arc(content))
    assert [block.partition(b"\r\n\r\n")[2] for _, _, block in found] == bodies
    assert [f["URL"] for _, f, _ in found] == [f"http://h/{i}" for i in range(3)]
    with pytest.raises(ValueError):
        list(warc.parse_arc(content[:-5]))
    assert warc._iso("19970305") == "1997-03-05T00:00:00Z"


CASES = [
    ("<p>one<p>two <b>b</b>old<br>next", "one\n\ntwo bold\nnext"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  1. x\n  2. y\n- c"),
    ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>after", "k         value\nlong key  1\n\nafter"),
    ("<head><title>no</title></head><div hidden>no</div><div style='display: none'>no<p>no</div>yes<script>if(a<b){}</script>", "yes"),
    ("<pre> a\n  b</pre>x  \n y", " a\n  b\n\nx y"),
    ("a &amp; b &lt;i&gt;<!-- c --> d", "a & b <i> d"),
    ("<dl><dt>t<dd>d</dl><h1>h</h1>p", "t\nd\n\nh\n\np"),
    ("x<textarea>in</textarea><br/>y</p>z", "xin\ny\n\nz"),
    ("", ""),
    ("<", "<"),
    ("</li></table></ul>x<td>y", "x y"),
    ("<a title='>'>q</a>", "q"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_html_layout(page, text):
    assert html_text.rendered(page).strip() == text.strip()


SHOWN = [
    ('<p class="col hidden md:block">a</p><p title="the hidden valley">b</p><p style="overflow: hidden !important">c</p>', "a\n\nb\n\nc"),
    ("<a data-style='display:none' href=x?hidden>a</a><b type=hidden>b</b>", "ab"),
    ("a<p style='display:none'>x</p><p style=display:none>x</p><p style=\"visibility: HIDDEN\">x</p><p HIDDEN=''>x</p>", "a"),
    ("<p style='display:none; display: block'>a</p><p style='display:none !important; display:block'>x</p>", "a"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("a<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text>b</text><text>c</text></svg>d", "a\nb\nc\nd"),
    ("<svg><defs/><text>b</text></svg>", "b"),
    ("in <select><option>a<option selected>b<option>c</select> now", "in b now"),
    ("<select><option disabled>a</option><option>b</option></select>", "b"),
    ("x<select multiple><option>a</option><option>b</option></select>y", "x\na\nb\ny"),
]


@pytest.mark.parametrize("page,text", SHOWN)
def test_html_shows_what_a_browser_shows(page, text):
    assert html_text.rendered(page).strip() == text


DEEP = [
    ("<b>" * 2000 + "<table><tr><td>a</td><td>b</td></tr><tr><td>long</td><td>c</td></tr></table>", "a     b\nlong  c"),
    ("<span>" * 2000 + "x<div hidden>no</div>y", "xy"),
    ("<div hidden>" + "<i>" * 600 + "<div>no</div>no" + "</i>" * 600 + "</div>yes", "yes"),
    ("<div>" * 50_000 + "a<ul><li>b<li>c</ul>", "a\n\n- b\n- c"),
]


@pytest.mark.parametrize("page,text", DEEP)
def test_html_at_any_depth(page, text):
    assert html_text.rendered(page).strip() == text


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "head"):
            self.skip += tag != "head"

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_html_keeps_every_visible_word(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = spark.createDataFrame([(-1, None, "t"), (-2, "<div>" * 3000 + "deep" + "</p>" * 50, "t")], "page_id long, html string, text string")
    every = pages.select("page_id", "html", F.lit("clash").alias("text")).union(extra)
    got = {r.page_id: r.text for r in html_text.page_text(every, ["page_id"]).collect()}
    assert got[-1] == "" and got[-2] == "deep"
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        want = "".join("".join(p.out).split())
        have = "".join(x.removeprefix("- ") for x in got[r.page_id].split("\n"))
        assert "".join(have.split()) == want
    assert html_text.page_text(pages.filter("false"), ["page_id"]).count() == 0


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(1)
    words = [[f"d{k}w{i}" for i in range(30)] for k in range(3)]
    rows = []
    for i in range(600):
        k = int(rng.choice(3, p=[0.6, 0.3, 0.1]))
        rows.append((i, " ".join(rng.choice(words[k] + ["shared"] * 10, 40)), k, "clash"))
    rows += [(1000, None, 0, "c"), (1001, "", 0, "c"), rows[0]]
    docs = spark.createDataFrame([(a, b, d, 1.0) for a, b, _, d in rows], "doc_id long, text string, tokens string, rate double")
    labels = spark.createDataFrame([(a, int(k == 1), int(k == 0)) for a, _, k, _ in rows[:300]] + [(None, 1, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    domains = (("one", "toxic = 1"), ("two", "quality = 1"), ("three", "quality = 0"))
    out, fit = mixing.mixed(docs, labels, domains, [0.4, 0.35, 0.25])
    got = out.collect()
    assert len(got) == len(rows)
    truth = {a: k for a, _, k, _ in rows}
    held = [r for r in got if 300 <= r.doc_id < 600]
    assert np.mean([int(np.argmax(r.p)) == truth[r.doc_id] for r in held]) > 0.95  # rows the classifier has not seen
    assert all(r.rate >= 0 for r in got)
    reached = np.array([sum(r.rate * r.tokens * r.p[k] for r in got) for k in range(3)])
    assert reached == pytest.approx(fit["reached"], rel=1e-6)
    total = sum(r.tokens for r in got)
    assert np.abs(reached / total - [0.4, 0.35, 0.25]).max() < 0.03
    twice = [r.rate for r in got if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_mixing_without_labels_or_docs(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, _ = mixing.mixed(docs, labels, DOMAINS, SHARES)
    assert out.first().p == pytest.approx([1 / 3] * 3)
    assert mixing.mixed(docs.filter("false"), labels, DOMAINS, SHARES)[0].count() == 0


def test_projected_gradient_is_least_squares():
    """The fitted rates are a stationary point of the objective, found by a plain long descent."""
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3] * 3, 50), rng.integers(1, 100, 50).astype(float)
    target, size = np.array([0.2, 0.2, 0.6]) * t.sum(), t.sum()
    residuals = np.zeros((0, 3))
    for _ in range(2000):
        residuals = np.vstack([residuals, ((mixing._rates(p, residuals)[1] * t) @ p - target) / size]) if len(residuals) < 400 else residuals
    r = mixing._rates(p, residuals)[0]
    slow = np.ones(50)
    for _ in range(20000):
        slow = np.clip(slow - 0.5 * (p @ (((slow * t) @ p - target) / size) + mixing.RIDGE * (slow - 1)), 0, mixing.MOST)
    assert r == pytest.approx(slow, abs=1e-2)


@pytest.mark.parametrize("have,shares", [([0.12, 0.5, 0.38], [0.02, 0.93, 0.05]), ([0.008, 0.6, 0.392], [0.02, 0.5, 0.48]), ([0.4, 0.35, 0.25], [0.0, 0.5, 0.5])])
def test_mixing_meets_each_target(spark, have, shares):
    """Each domain's total comes within a small share of its own target, for small domains and near-pure posteriors too."""
    rng = np.random.default_rng(3)
    rows = []
    for kind in rng.permutation(np.repeat(range(3), np.rint(np.array(have) * 2000).astype(int))):
        p = np.full(3, 1e-5)
        p[kind] = 1.0
        rows.append((100, (p / p.sum()).tolist()))
    residuals, target, reached = mixing.fitted(spark.createDataFrame(rows, "tokens long, p array<double>"), 3, shares)
    p, t = np.array([p for _, p in rows]), np.array([t for t, _ in rows])
    rates = mixing._rates(p, residuals)[0]
    assert (rates * t) @ p == pytest.approx(reached, rel=1e-6, abs=1e-3)
    assert reached == pytest.approx(target, rel=1e-2, abs=1e-4 * t.sum())
    soft = spark.createDataFrame([(50, [0.3, 0.4, 0.3]), (50, [0.5, 0.3, 0.2])], "tokens long, p array<double>")
    assert np.isfinite(mixing.fitted(soft, 3, shares)[0]).all()  # no rates meet these


def test_mixing_leaves_documents_alone_where_a_target_cannot_be_met(spark):
    """A domain of which hardly anything is left is missed; the others are met, and clean documents stay."""
    rng = np.random.default_rng(4)
    bad = rng.random(3000) < 0.07
    p = np.stack([np.where(bad, 0.8, 0.01), np.where(bad, 0.2, 0.99), rng.random(3000) * 4e-4], axis=1)
    p /= p.sum(axis=1, keepdims=True)
    t = rng.integers(50, 900, 3000)
    residuals, target, reached = mixing.fitted(spark.createDataFrame([(int(n), x) for n, x in zip(t, p.tolist())], "tokens long, p array<double>"), 3, [0.02, 0.93, 0.05])
    rates = mixing._rates(p, residuals)[0]
    assert reached[:2] == pytest.approx(target[:2], rel=0.01) and reached[2] < 0.01 * target[2]
    assert rates[~bad].min() > 0.9 and rates.max() <= mixing.MOST and rates[bad].max() < 0.3


#: Names that operators add or use.
CLASHING = ("kept", "rejected_by", "n_words", "n_hit", "items", "spans", "_text", "tokens", "p", "rate", "copies", "copy", "size", "shard", "slot", "before", "place", "part", "stays", "label", "text_hash", "c0", "c_id", "k_id", "virtual_slot", "next_shard", "text_crc32", "n", "class", "component_id")
SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_quality(t):
    w = re.findall(SPACE, t or "")
    n = len(w)
    three = [tuple(w[i : i + 3]) for i in range(n - 2)]
    count = Counter(three)
    repeated = {i + k for i, g in enumerate(three) if count[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    lettered = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", x)) for x in w)
    symbols, chars = len(re.findall(r"[#*$%&|<>]", t or "")), sum(map(len, w))
    return not (
        n < 50 or 100 * len(repeated) > 50 * n or 100 * symbols > 20 * n or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or 100 * lettered < 40 * n
        or 100 * len(set(w)) < 5 * n or 100 * max(Counter(t).values()) > 50 * len(t) or chars < 2 * n or chars > 20 * n
    )


def plain_near_duplicates(rows):
    """The rows that stay, as a multiset; of equal ids with different texts in one component either may."""
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            groups.setdefault(find(i), []).append(d)
    return Counter([min(g) for g in groups.values()] + [d for i, (d, _) in enumerate(rows) if d is None or not sets[i]])


def plain_contaminated(t, tests):
    w = re.findall(ALNUM, (t or "").translate(LOW))
    hit = set()
    for x in tests:
        v = re.findall(ALNUM, (x or "").translate(LOW))
        k = min(13, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with nulls, repeated rows, one id with different texts, and columns whose names clash."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.filter("doc_id < 12").collect()
    extra = [(None, None, None, None, None), (-1, "", "en", "s", 0), (None, some[3].text, "en", "s", 0), (some[4].doc_id, some[7].text, "en", "s", 0), (some[5].doc_id, " ".join(f"v{i}" for i in range(30000)), "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).union(docs.limit(3)).union(docs.filter("doc_id = 9"))
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_pipeline_stages_against_plain_models(spark, crowded):
    d = "/root/testdata/sf0.001"
    tests = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    rows = pairs(crowded)
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stages[name](spark, crowded, d) for name in stages}
    for name, df in out.items():
        added = sharding.ADDED if name == "sharding" else ()
        assert [c for c in df.columns if c not in added] == [c for c in crowded.columns if c not in added], name
        own = [c for c in CLASHING if c not in added]
        assert df.filter(" or ".join(f"`{c}` <> 'own {c}'" for c in own)).count() == 0, name
    assert Counter(pairs(out["quality_rules"])) == Counter(x for x in rows if plain_quality(x[1]))
    assert Counter(i for i, _ in pairs(out["ngram_jaccard_join"])) == plain_near_duplicates(rows)
    assert Counter(pairs(out["benchmark_decontamination"])) == Counter(x for x in rows if not plain_contaminated(x[1], tests))
    placed = out["sharding"].collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(rows)
    assert all(r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in placed)
    of = {}
    for r in placed:
        of.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in of.values())
    mixed, fit = mixing.mixed(crowded, spark.read.parquet(f"{d}/labels.parquet"), DOMAINS, SHARES)
    rate = {r.doc_id: [] for r in mixed.collect()}
    for r in mixed.collect():
        rate[r.doc_id].append(r.rate)
    taken, had = Counter(i for i, _ in pairs(out["mixing_to_weights"])), Counter(i for i, _ in rows)
    for i, n in had.items():
        assert sum(map(math.floor, rate[i])) <= taken[i] <= sum(map(math.ceil, rate[i])), i
    assert set(fit["unmet"]) <= {name for name, _ in DOMAINS}


def test_pipeline_in_order_and_empty(spark, crowded):
    d = "/root/testdata/sf0.001"
    at, counts = crowded, []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.stored(stage(spark, at, d), name)
        counts.append(at.count())
    assert counts[0] < crowded.count() and counts[0] > counts[1] >= counts[2] and counts[-1] == counts[-2] > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, crowded.filter("false"), d).count() == 0


@pytest.mark.parametrize("unit", ["<a", "<a ", '<a b=">"', "<a \"'>", "<!--", "</ ", "<td rowspan=9999>x", "<tr><td rowspan=9999 colspan=1000>x", "<select>", "<style>{", "<a b='", "<li>", "<svg>", "&amp"])
def test_html_broken_markup_is_linear(unit):
    began = time.perf_counter()
    html_text.rendered(unit * (400_000 // len(unit)))
    html_text.rendered("<table>" + unit * (100_000 // len(unit)))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td colspan=2>head</td><td>c</td></tr><tr><td rowspan=2>x</td><td>yyy</td><td>z</td></tr><tr><td>q</td><td>w</td></tr></table>", "head    c\nx  yyy  z\n   q    w"),
        ("<table><tr><td>\u65e5\u672c</td><td>k</td></tr><tr><td>abcde</td><td>m</td></tr></table>", "\u65e5\u672c   k\nabcde  m"),
        ("<style>@media print{.x{display:none}} .h, #z, em{display:none}</style><p class='h x'>gone</p><p class=x>here <em>not</em></p><p id=z style='display:block'>shown</p>", "here\n\nshown"),
        ("a <b and c", "a <b and c"),
        ("x < y <i>z</i>", "x < y z"),
        ('<p class="x>lost</p><p>kept</p>', "lost\n\nkept"),
        ("<p>a<!-- <p>b -->c</p><!-- open <p>d", "ac"),
    ],
)
def test_html_spans_rules_and_stray_marks(page, text):
    assert html_text.rendered(page) == text


def test_html_table_columns_against_brute_force():
    """Each cell of random tables without spans starts where the widest texts of the columns before it end, and two blanks."""
    rng = random.Random(3)
    for _ in range(200):
        rows = [["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        width = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
        want = ["  ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in rows]
        assert html_text.rendered(page).split("\n") == want
