"""Filters, duplicates, personal data, page text and scores against plain versions."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hazardloom.llm import decontaminate, html_text, pii, quality_rules, simhash, suffix_dedup, suffix_tree_lm

from .conftest import AWKWARD, SF_DIR

SPACES = r"[\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


# --- quality rules ---------------------------------------------------------------------
def plain_stats(text):
    w, lines, seen = words(text), (text or "").split("\n"), set()
    times, covered = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if times[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    dup = 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_stats(texts):
    for text in [*texts.values(), *[t for _, t, _ in AWKWARD]]:
        assert quality_rules.text_stats(text)[:5] == plain_stats(text)


def test_binomial_bound_is_exact():
    for k, n, p in ((0, 50, 0.1), (3, 80, 0.05), (40, 100, 0.5), (9, 9, 0.3)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.exp(quality_rules.log_binomial_tail(k, n, p)) == pytest.approx(exact)


def test_cutoffs_reject_junk_and_keep_good_rows(spark):
    good, junk = "plain words that say one thing after another without any noise at all number {}", "bad$$$ words### full*** of%%% signs&&& one$$$ two### three*** four%%% five&&& {}"
    rows = [(i, (junk if i % 4 == 0 else good).format(i), "en" if i % 3 else "de") for i in range(3000)]
    rows += [(10_000 + i, (junk if i % 4 == 0 else good).format(i), "xx") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 3000, 2)], "doc_id long, quality int")
    judged = quality_rules.quality_rules(docs, labels).collect()
    for r in judged:
        assert not r["base_failed"]
        if r["lang"] != "xx":
            assert r["kept"] == (r["doc_id"] % 4 != 0)
    few = quality_rules.quality_rules(docs, labels.limit(30)).where("not kept").count()
    assert few == 0  # too little evidence certifies nothing


def test_quality_rules_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(awkward, labels).collect()
    assert len(got) == len(AWKWARD)
    assert sorted((r["doc_id"] or 0, *[r[c] for c in quality_rules.STATS[:5]]) for r in got) == sorted(
        ((d or 0), *plain_stats(t)) for d, t, _ in AWKWARD
    )
    assert quality_rules.quality_rules(awkward.limit(0), labels.limit(0)).count() == 0


def test_every_stratum_has_its_own_cutoffs(spark):
    """More strata than 64: each is certified by itself, and one without labels rejects nothing."""
    good, junk = "plain words that say one thing after another without any noise at all number {}", "bad$$$ words### full*** of%%% signs&&& one$$$ two### three*** four%%% five&&& {}"
    rows = [(i, (junk if i % 8 == 0 else good).format(i), f"s{i // 500}") for i in range(80 * 500)]
    rows += [(100_000 + i, junk.format(i), "none") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(80 * 500).selectExpr("id as doc_id", "int(id % 8 != 0) as quality")
    judged = quality_rules.quality_rules(docs, labels)
    assert judged.where("lang = 'none' and not kept").count() == 0
    assert judged.where("lang != 'none' and kept != (doc_id % 8 != 0)").count() == 0


# --- SimHash ---------------------------------------------------------------------------
def plain_fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(fps))]


def test_fingerprints(texts):
    for text in [*list(texts.values())[:80], *[t for _, t, _ in AWKWARD]]:
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_close_pairs_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(500):
        flip = [int(b) for b in rng.choice(64, 3, replace=False)]
        difference = sum(1 << b for b in flip)
        assert any(difference & m == 0 for m in simhash.FIRST)
        for k, first in enumerate(simhash.FIRST):
            if difference & first == 0:
                assert any(difference & m == 0 for m in simhash.SECOND[k])


@pytest.mark.parametrize("limit", [2, 4096])
def test_links_and_components(spark, limit):
    """Chains and dense groups, through the first cut alone and through both."""
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for _ in range(300):
        fps.append(fps[int(rng.integers(len(fps)))] ^ sum(1 << int(b) for b in set(rng.integers(0, 63, int(rng.integers(1, 5))))))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f, 1000 + i) for i, f in enumerate(fps)], "fp long, id long")
    found = {r["fp"]: r["component_id"] for r in simhash.components(nodes, simhash.links(nodes, limit)).collect()}
    assert [found[f] for f in fps] == [1000 + x for x in plain_components(fps)]


def test_near_duplicates(spark, awkward, documents, texts):
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    expected = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, plain_components(fps), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == expected
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] == 4].count(4) == 3
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------------------
def test_contamination(spark, awkward):
    item = "jumps over the lazy dog and runs away from 12 angry"
    items = [(1, item), (1, item), (2, "One short line"), (3, ""), (4, None), (None, "Another text of the same id, with some words in it"),
             (5, "line"), (6, "zebra words never seen")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    got = decontaminate.contamination(awkward, benchmark).collect()
    assert len(got) == len(AWKWARD)
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    windows = {}
    for item_id, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[k : k + 10]), set()).add(item_id)
    expected = []
    for doc_id, text, _ in AWKWARD:
        w, hit, named = split(text), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    named |= ids
        expected.append((doc_id, len(w), len(hit), sorted(str(i) for i in named if i is not None)))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(expected, key=repr)
    assert decontaminate.contamination(awkward.limit(0), benchmark).count() == 0
    clean = decontaminate.digest(decontaminate.contamination(awkward, benchmark.limit(0))).collect()
    assert len(clean) == len(AWKWARD) and not any(r["contaminated"] for r in clean)


def test_benchmark_in_passes(spark, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.digest(decontaminate.contamination(documents, benchmark)).collect()))
    monkeypatch.setattr(decontaminate, "PASS_SHINGLES", 500)
    assert sorted(map(tuple, decontaminate.digest(decontaminate.contamination(documents, benchmark)).collect())) == whole


# --- personal data ---------------------------------------------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            doubled = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1]))
            if kind == "card" and (not 12 <= len(digits) <= 19 or doubled % 10):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), number, m.end(), m[0]))
    return sorted(out)


HARD = [
    "a@b.co_x@y.zz 1.2.3.4.5.6.7.8 é 300.1.2.3 256.1.1.1.9 00255.1.1.1", "a@b@c.de. x@-..b@c.d 🙂 q%w+e@h-i.j.k.", "+1 2 3 4 5 6 7 8 9 0 +12 +1(2)3-4.5 6789 +",
    "4041894974608795 4041 8949 7460 8795 4041-8949-7460-8795 4041  8949 12 4041894974608795", "@", "x" * 5000 + "@" + "y." * 400 + "z", "1" * 3000, "9.9.9.9" * 300,
    "call +1 (988) 555-2485, or +1 (988) 555-2485 and +44 20 7946 0958 12 34 56",
]


def test_personal_data(spark, awkward):
    rows = [*AWKWARD, *[(100 + k, t, "en") for k, t in enumerate(HARD)]]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    got = pii.with_spans(docs, None, {}).collect()
    found = [(r["doc_id"], [tuple(s) for s in r["base"]]) for r in got]
    assert sorted(found, key=repr) == sorted(((d, plain_spans(t)) for d, t, _ in rows), key=repr)
    assert pii.digest(pii.personal_data(docs.limit(0))).count() == 0
    whole = pii.personal_data(awkward)
    assert whole.columns == awkward.columns and whole.count() == len(AWKWARD)
    assert sum(len(r["base"]) for r in whole.collect()) == sum(len(plain_spans(t)) for _, t, _ in AWKWARD)


def test_added_spans_and_redaction(spark):
    """The trees learn from base spans to accept other formats, and broken ones stay."""
    rows = []
    for i in range(600):
        card = f"40418949746{i:04d}"
        check = next(c for c in "0123456789" if plain_spans(card + c))
        n = f"{200 + i % 700}) 555-{1000 + i}"
        rows.append((i, f"words about it, mail u{i}.x@host{i % 9}.example.com, from 10.{i % 250}.3.{i % 99} card {card}{check} call +1 ({n} soon"))
    rows += [(9000, "reach me: joe.doe (at) mail3.example.com, 10[.]2[.]33[.]4 (988) 555-2485 now"), (9001, "version 10.1 of 2024, item 12345, nothing else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(docs)
    got = {r["doc_id"]: r for r in found.where("doc_id >= 9000").collect()}
    assert {s["kind"] for s in got[9000]["spans"]} >= {0, 1, 3} and not got[9000]["base"]
    assert not got[9001]["spans"]
    out = found.where("doc_id in (5, 9001)").select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    texts = {r["doc_id"]: r["t"] for r in out}
    assert texts[5] == "words about it, mail [EMAIL], from [IP] card [CARD] call [PHONE] soon"
    assert texts[9001] == rows[-1][1]


LOOSE_FORMS = {
    "email": ["joe(AT)mail3.example.com", "joe.doe{at}mail3.example.com", "joe at host dot com", "joe [At] host [DOT] com", "joe @ host.com"],
    "ip": ["10[.]2.33[.]4", "10(.)2(.)33(.)4", "10 dot 2 dot 33 dot 4", "10[.]2[.]33[.]4"],
    "phone": ["0049 30 1234567", "(030) 1234567", "030/1234567", "01 23 45 67 89", "(988) 555-2485", "555-2485"],
}


def test_other_formats_are_proposed(spark):
    rows = [(kind, form, f"bitte {form}, danke") for kind, forms in LOOSE_FORMS.items() for form in forms]
    docs = spark.createDataFrame(rows, "kind string, form string, text string")
    for r in docs.withColumn("found", pii.candidates(F.col("text"))).collect():
        assert (pii.KINDS.index(r["kind"]), r["form"]) in {(s["kind"], s["found"]) for s in r["found"]}


def test_other_formats_are_judged(spark):
    rows = []
    for i in range(2400):
        card = f"40418949746{i:04d}"
        check = next(c for c in "0123456789" if plain_spans(card + c))
        phone = f"+1 ({200 + i % 700}) 555-{1000 + i}" if i % 2 else f"+49 {30 + i % 60} {1000000 + 37 * i}"
        rows.append((i, f"words about it, mail u{i}.x@host{i % 9}.example.com, from 10.{i % 250}.3.{i % 99} card {card}{check} call {phone} soon"))
    right = [
        "mail joe.doe(AT)mail3.example.com now", "mail joe.doe at mail3 dot example dot com now", "from 10[.]2.33.4 now",
        "from 10 dot 2 dot 33 dot 4 now", "call 0049 30 1234567 now", "call (030) 1234567 now",
    ]
    wrong = ["on 2024-03-15 it", "from 1950-1999 it", "steps 1. 2. 3. 4 of it", "look at home.The rest", "about 12.3456789 of it"]
    rows += [(9000 + k, t) for k, t in enumerate([*right, *wrong])]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 9000").collect()
    got = {r["doc_id"] - 9000: [s["kind"] for s in r["spans"]] for r in found}
    assert [got[k] for k in range(len(right))] == [[0], [0], [1], [1], [3], [3]]
    assert not any(got[k] for k in range(len(right), len(got)))


# --- page text -------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main" class='content'><article class=post>
<h2>Title &amp; more</h2><p>First&nbsp;paragraph, with <b>bold</b> text,
 and a <a href="y">link</a> in it; long enough to count.<p>Second one<br>after a break &lt;here&gt; &copy; 2 &unknown; &#233;
<div class="ad">Buy now</div><ul><li>point one<li>point two</ul><form><input value=x>Send</form></article>
<aside>See also</aside><section id="comments"><article class="comment"><p>I, like, this, very, much, indeed, yes.</p></article></section>
</div><footer>&copy; 2024</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == (
        "Title & more First paragraph, with bold text, and a link in it; long enough to count. "
        "Second one after a break <here> © 2 &unknown; é point one point two"
    )
    plain = "<html><body><div class=menu><a>a</a></div><h1>Head</h1><p>Some words, and more words here.</p><p>Others.</p></body>"
    assert html_text.main_text(plain) == "Head Some words, and more words here. Others."
    for nothing in (None, "", "  ", "<html></html>", "<nav><a>x</a></nav>", "<script>x"):
        assert html_text.main_text(nothing) == ""
    for broken in ("<p>a <b", "<p>a < b and c", "</div></p><p>x</i></p>", "<<<>>><p>y", "<p title='>z", "<div>" * 3000 + "deep" + "</div>" * 3000):
        html_text.main_text(broken)
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<article><p>" + "long words, here " * 20_000 + "</p></article>").endswith("here")


PARAGRAPHS = [f"Paragraph {i} of the article, with some words, and more words to fill it up nicely." for i in range(4)]
LAYOUTS = [
    '<div class="content-sidebar-wrap"><article>%s</article></div>', '<div id="content" class="has-sidebar">%s</div>',
    '<main class="has-comments">%s</main>', '<article class="post comments-open">%s</article>', '<div class="social-science">%s</div>',
    '<form id="aspnetForm" method="post"><input type="hidden" value="x"><label>Search</label> <button>Go</button>%s</form>',
    '<div class="widget-area sidebar"><main>%s</main></div>', "<div>%s</div>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_articles_in_misleading_containers(layout):
    article = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    comment = "<p>A comment, which is rather long, with commas, and many more words than one would like.</p>"
    around = '<html><body class="no-sidebar cookie-notice-shown"><nav><a href="/">Home</a></nav>%s{}<footer>foot</footer></body></html>'
    for name in ("comments", "comment-list", "post-comments"):
        page = around.format(f'<div class="{name}">{comment * 2}</div>') % (layout % article)
        assert html_text.main_text(page) == " ".join(["Title", *PARAGRAPHS])


def test_labels_and_buttons_amid_a_sentence():
    page = "<article><p>Press the <button>OK</button> key, then <label>tick</label> it, to go on.</p><div><button>Share</button></div></article>"
    assert html_text.main_text(page) == "Press the OK key, then tick it, to go on."


@pytest.mark.parametrize("nothing", ['<div class="cookie-notice"><p>We use cookies.</p></div>', '<form><label>Name</label><button>Send</button></form>'])
def test_pages_without_an_article(nothing):
    assert html_text.main_text(f"<html><body>{nothing}</body></html>") == ""


@pytest.mark.parametrize("piece", ["<div>", "<div>a", "<blockquote>a", "<p><b>", "</x>", "<li>a", "<form><label>a"])
def test_deep_pages_take_linear_time(piece):
    def seconds(n):
        start = time.perf_counter()
        html_text.main_text(piece * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.02)


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>é, x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.page_texts(pages).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] is None] == ["é, x"]
    assert html_text.page_texts(pages.limit(0)).count() == 0


def test_given_pages_keep_their_article(spark):
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(40).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        cut = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\n", article))
        assert html_text.main_text(r["html"]) == " ".join(html_text.unescape(cut).split())


# --- suffix deduplication --------------------------------------------------------------
def brute_force(texts, length=suffix_dedup.LENGTH):
    """Maximal removed spans by counting every window."""
    times = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            key = hashlib.blake2b(t[p : p + length], digest_size=16).digest()
            times[key] = times.get(key, 0) + 1
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if times[hashlib.blake2b(t[p : p + length], digest_size=16).digest()] > 1:
                covered[p : p + length] = True
        out.append(suffix_dedup._stretches(covered))
    return out


def removed(rows):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows), key=repr)


def plain_removed(rows):
    data = [(t or "").encode() for _, t, _ in rows]
    out = []
    for (doc_id, _, _), text, spans in zip(rows, data, brute_force(data), strict=True):
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        out.append((doc_id, len(text), len(text) - len(kept), len(spans), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_runs", [2048, 1])
def test_suffix_dedup(spark, awkward, monkeypatch, bucket_runs):
    """Through sorted buckets and through counted windows, against counting every window."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", bucket_runs)
    assert removed(suffix_dedup.without_repeats(awkward).collect()) == plain_removed(AWKWARD)
    assert suffix_dedup.without_repeats(awkward.limit(0)).count() == 0


def test_suffix_dedup_with_shared_passages(spark, texts):
    rng = np.random.default_rng(4)
    pool = "".join(t for t in list(texts.values())[:40])
    rows = []
    for i in range(60):
        parts = []
        for _ in range(3):
            at, n = int(rng.integers(len(pool) - 900)), int(rng.integers(200, 900))
            parts.append(pool[at : at + n])
        rows.append((i, " | ".join(parts), "en"))
    stored = spark.conf.get("spark.checkpoint.dir") + "/passages"
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.mode("overwrite").parquet(stored)
    assert removed(suffix_dedup.without_repeats(spark.read.parquet(stored)).collect()) == plain_removed(rows)


def test_runs_in_pieces_agree(monkeypatch):
    """A text cut into overlapping pieces has every window in exactly one run."""
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 101, 5000).astype(np.uint8))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    windows = []
    for _, offset, held in suffix_dedup._joined([text]):
        first, last, *_ = suffix_dedup.runs(np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]))
        windows += [offset + p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
    assert sorted(windows) == list(range(5000 - 399))


# --- language model --------------------------------------------------------------------
def test_base_scores(spark, awkward):
    got = suffix_tree_lm.scores(awkward).collect()
    tokens = [(d, [*words(lower(t)), None]) for d, t, _ in AWKWARD]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    expected = sorted(
        ((d, held(d), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for d, ws in tokens),
        key=repr,
    )
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr)
    assert found == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert suffix_tree_lm.scores(awkward.limit(0)).count() == 0


def test_rare_words_are_joined(spark, documents, monkeypatch):
    every = {r["doc_id"]: r for r in suffix_tree_lm.scores(documents).collect()}
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", 50)
    for r in suffix_tree_lm.scores(documents).collect():
        same = every[r["doc_id"]]
        assert r["n_known"] == same["n_known"]
        assert r["base_score"] == pytest.approx(same["base_score"]) and r["score"] == pytest.approx(same["score"])


def test_every_context_that_passes_is_used(spark):
    """More contexts than a fixed model of 20,000 states would hold: each raises the score of its own texts."""
    n = 24_000
    rows = spark.range(n * 6).selectExpr("id as doc_id", f"concat('a', id % {n}, ' b', id % {n}) as text")
    got = suffix_tree_lm.scores(rows).where("not held_out").withColumn("pair", F.col("doc_id") % n)
    # A text is scored by its context a.. -> b.., so a pair that was left out would stay at its base score.
    pairs = got.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("score") - F.col("base_score")).alias("more"))
    pairs = pairs.where(F.col("n") >= suffix_tree_lm.LEAST_COUNT).toPandas()
    assert len(pairs) > 21_000
    assert pairs["more"].min() > 1


def plain_tree_scores(rows, penalty, least):
    """Score of every (id, text) with contexts of any length, in plain loops, and the retained contexts."""
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    texts = [(d, [*words(lower(t)), None]) for d, t in rows]
    counts = {}
    for d, ws in texts:
        if not held(d):
            for at, w in enumerate(ws):
                for k in range(at + 1):
                    counts.setdefault(tuple(ws[at - k : at]), Counter())[w] += 1
    root = counts[()]
    total, kept = sum(root.values()), {}
    for context, after in counts.items():
        n = sum(after.values())
        if context and n >= least:
            shorter = counts[context[1:]]
            gain = sum(c * math.log(c / n / (shorter[w] / sum(shorter.values()))) for w, c in after.items())
            if gain >= penalty * len(after):
                kept[context] = after, n
    out = []
    for d, ws in texts:
        score = 0.0
        for at, w in enumerate(ws):
            p = (root[w] + 1) / (total + len(root) + 1)
            for k in range(1, at + 1):
                if found := kept.get(tuple(ws[at - k : at])):
                    p = (found[0][w] + len(found[0]) * p) / (found[1] + len(found[0]))
            score += math.log10(p)
        out.append((d, score))
    return sorted(out, key=repr), kept


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_contexts_run_over_the_text(spark, monkeypatch, bits):
    """Any depth, long words, other scripts, and the end: as plain loops say, also with a full table of bits."""
    monkeypatch.setattr(suffix_tree_lm, "MOST_BITS", bits)
    rng = np.random.default_rng(3)
    pool = ["the", "old", "Extraordinarily", "中文字", "ß", "sea", "was", "x" * 40]
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, " ".join(rng.choice(pool, int(rng.integers(0, 30))))) for i in range(120)]
    # What follows a line is told by the word before it, twelve words back.
    rows += [(200 + i, f"{('left', 'right')[i % 2]} {line} {('red', 'blue')[i % 2]}") for i in range(60)]
    rows += [(300, "a b " * 40), (301, None), (302, ""), (None, "the old sea")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected, kept = plain_tree_scores(rows, suffix_tree_lm.PENALTY, suffix_tree_lm.LEAST_COUNT)
    assert max(map(len, kept)) == 13
    got = sorted(((r["doc_id"], r["score"]) for r in suffix_tree_lm.scores(docs).collect()), key=repr)
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected])


def test_word_order_counts(spark):
    text = "the cat sat on the mat and the dog lay by the door"
    # 3 is not held out, 5 and 9 have the same words.
    rows = [(3 + 1000 * i, text) for i in range(40)] + [(5, text), (9, " ".join(reversed(text.split())))]
    got = {r["doc_id"]: r for r in suffix_tree_lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5]["base_score"] == pytest.approx(got[9]["base_score"])
    assert got[5]["score"] > got[9]["score"] + 1


def test_pii_learns_from_every_span(spark):
    """More spans of a kind than a bounded sample would hold all weigh in, once per distinct span."""
    n = 2_600
    docs = spark.range(n).selectExpr("concat('write to user', id, '@host', id % 50, '.example.org today') as text")
    rows = pii.learning_rows(docs.union(docs.limit(500)), "text").groupBy("kind", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    found = {(r["kind"], r["label"]): r for r in rows.collect()}
    assert {k: r["w"] for k, r in found.items()} == {(0, 0.0): n, (0, 1.0): n}
    assert all(r["n"] < n / 4 for r in found.values())  # equal features are one row
    model, cutoffs = pii.fit(docs, "text")
    assert model is not None and 0 in cutoffs
