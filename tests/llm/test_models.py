"""Language identification, toxicity, HTML extraction."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import CLASHING, awkward
from streamloom.llm import langid, sitetree, toxicity, wordhash

SYLLABLES = {"aa": "ka to mi ru se no", "bb": "schtz ber ung lich keit ver", "cc": "éaux ille çon ère tion ou"}


def prose(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


# --- language ---------------------------------------------------------------------------------------------


def test_languages_on_held_out_documents(spark):
    rng = random.Random(0)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)).collect()
    lang = {d: x for d, _, x in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_rare_languages_are_learned(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, rng.randint(8, 40)), lang) for i in range(600) for lang in ["cc" if i % 60 == 1 else rng.choice(["aa", "bb"])]]
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)")), train_docs=60).collect()
    lang = {d: x for d, _, x in rows}
    assert sum(r["lang_pred"] == lang[int(r["doc_id"])] for r in got) >= 0.97 * len(got) and all(r["lang_pred"] == "cc" for r in got if lang[int(r["doc_id"])] == "cc")
    assert langid.quotas({"a": 3, "b": 100, "c": 100}, 43) == {"a": 3, "b": 20, "c": 20} and langid.quotas({}, 5) == {} and langid.quotas({"a": 9}, 4) == {"a": 4}


def test_languages_awkward_rows(spark):
    df = awkward(spark)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(df).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got and all(p in ("en", "de") for d, p in got if d in (1, 2, 6, 7))
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_grams_are_the_same_in_pieces(monkeypatch):
    grams = langid.Grams()
    text = "Hello, World! çà 𝒳𝒳 123 " * 20
    whole = Counter(b for g in grams.of(text) for b in g.tolist())
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert Counter(b for g in grams.of(text) for b in g.tolist()) == whole and sum(whole.values()) == 3 * len(grams.codes(text))
    assert not list(grams.of("12 3 !")) and not list(grams.of(""))


# --- toxicity ------------------------------------------------------------------------------------------------


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [prose(rng, "aa", rng.randint(3, 9)) for _ in range(rng.randint(1, 8))]
        toxic = rng.random() < 0.3
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["vilegu", "vilegor", "grubble", "Snork"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents_and_its_sentences(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    truth, text = dict(labels), dict(docs)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["predicted"] == truth[r["doc_id"]] for r in held)
    for r in held:
        if truth[r["doc_id"]]:
            worst = text[r["doc_id"]].encode()[r["worst_start"] : r["worst_end"]].decode()
            assert any(w in worst for w in ("vile", "grubble", "Snork"))


def test_features_with_evidence_equal_brute_force(spark):
    docs, labels = toxic_corpus(200, 3)
    rows = spark.createDataFrame([(str(i), t, y) for (i, t), (_, y) in zip(docs, labels)], "doc_id string, text string, toxic int").repartition(5)
    bags = toxicity.Bags()
    df, toxic = Counter(), Counter()
    for (_, t), (_, y) in zip(docs, labels):
        for f in set(bags.of([t])[0].tolist()):
            df[f] += 1
            toxic[f] += y
    n, p = len(docs), sum(y for _, y in labels)

    def ll(k, m):
        return sum(x * math.log(x / m) for x in (k, m - k) if x > 0) if m else 0.0

    want = sorted(f for f in df if 2 * (ll(toxic[f], df[f]) + ll(p - toxic[f], n - df[f]) - ll(p, n)) >= toxicity.MIN_EVIDENCE)
    assert toxicity.features_with_evidence(rows).tolist() == want and want


def test_bare_sentences_count_as_sentences():
    rng = random.Random(6)
    bags = []
    for i in range(60):
        features = np.array([7] if i % 3 == 0 and i % 2 else [3] if i % 2 else [], dtype=np.uint32)
        bags.append((int(i % 3 == 0), 1.0, features, np.zeros(len(features), np.int64), rng.randint(0, 4)))
    model = toxicity.fit(bags, rounds=50)
    assert model.words.tolist() == [3, 7] and model.weights[1] > 0 > model.weights[0]
    # a text of three sentences, one of which has a feature: noisy-or of all three
    z = model.sentence_logits(np.array([7, 5], np.uint32), np.array([1, 0]), 3)
    p = [1 / (1 + math.exp(-x)) for x in (model.bias, model.bias + model.weights[1], model.bias)]
    assert model.score(z, np.zeros(3, np.int64), 1)[0] == pytest.approx(1 - (1 - model.leak) * math.prod(1 - x for x in p))


def test_toxicity_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None), (8, 0), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and all(r["worst_start"] is None for r in got if r["doc_id"] in (3, 4, 5))
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.0}


def test_word_hashes(monkeypatch):
    for table in (wordhash.blank_table(True), wordhash.letter_table()):
        hasher = wordhash.WordHasher(table)
        buf, _ = wordhash.joined(["Abc abd abc\x00 ABC", "", "a\tb " * 500, "x" * 3000 + " y"])
        starts, ends, hashes, three = hasher.words(buf, (3,))
        raw = bytes(buf)
        low = [bytes(table[list(raw[a:b])]) for a, b in zip(starts, ends)]
        assert len(set(low)) == len(set(hashes.tolist())) and len(set(w[:3] for w in low)) == len(set(three.tolist()))
        monkeypatch.setattr(wordhash, "CHUNK", 64)
        again = hasher.words(buf, (3,))
        assert all((x == y).all() for x, y in zip((starts, ends, hashes, three), again))
        monkeypatch.undo()


# --- HTML ------------------------------------------------------------------------------------------------------

PAGES = [
    ("<body><header>Head</header><article><h1>T&eacute;st</h1><p>One <b>b</b>old<p>Two&nbsp; x<br>y</article><footer>f</footer>", "Tést One bold Two x y"),
    ("<div class='content'><p>Text</p><div class='comments'><p>bad</p></div><div id=ad-1>buy</div><ul><li>a<li>b</ul></div><aside>x</aside>", "Text a b"),
    ("<p>a</p><script>if(a<b){'</p>'}</script><!-- c --><style>p{}</style><form>f<input></form><p hidden>h</p><p style='display: none'>n</p>z", "a z"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("plain &lt;b&gt; &amp;amp text", "plain <b> &amp text"),
    ("", ""), ("<", "<"), ("<!--", ""), ("<p", ""), ("</div></p>x", "x"), ("<nav>only</nav>", ""),
    ("<main><article>one</article><aside>no</aside><article>two</article></main>", "one two"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert sitetree.main_text(page) == text


KEPT = [
    ("<div class='layout has-sidebar'><article>long text</article><div class=sidebar>side</div></div>", "long text"),
    ("<article class='post comments-open category-social'>text<div class=comments>c</div></article>", "text"),
    ("<form id=aspnetForm><div class=search>find</div><article>text</article></form><div class=site-footer>f</div>", "text"),
    ("<form id=aspnetForm><p>most of the text</p></form><p>rest</p>", "most of the text rest"),
    ("<head><title>t</title><meta charset=x><body><p>text</p>", "text"),
    ("<head><title>t</title><p>text</p>", "text"),
    ("<article>a<section id=discussion>b</section><h2 id=related-work>c</h2><section id=recommendations>d</section><div id=comments>e</div></article>", "a b c d"),
    ("<article>the article itself</article><div class=related><article>teaser</article></div>", "the article itself"),
]


@pytest.mark.parametrize("page, text", KEPT)
def test_names_and_forms_do_not_remove_the_main_part(page, text):
    assert sitetree.main_text(page) == text


def test_extraction_of_awkward_rows(spark):
    rows = [(i, f"http://h{i}.x/", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, None), (3, "no host", PAGES[3][0]), (50, "", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for c in CLASHING:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("extra"))
    got = sitetree.extract(df).collect()
    want = {**{i: t for i, (_, t) in enumerate(PAGES)}, None: "", 50: "deep"}
    assert len(got) == len(rows) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert sitetree.extract(df.limit(0)).count() == 0


def test_branches_alike_on_all_pages_go(spark):
    rng = random.Random(4)
    body = "<body><div><ul><li>home</li><li>about us</li></ul></div><div class=c><p>{}</p><p>{}</p></div><div><span>all rights</span></div></body>"
    rows = [(i, "https://user@Site.example:80/p", body.format(prose(rng, "aa", 9), prose(rng, "bb", 5))) for i in range(30)]
    rows += [(100, "http://lonely.example/", body.format("x", "y"))]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("home" not in got[i] and "rights" not in got[i] and len(got[i].split()) == 14 for i in range(30))
    assert got[100] == "home about us x y all rights"


def test_the_tree_alone_removes_what_recurs(spark, monkeypatch):
    rng = random.Random(7)
    page = "<body><nav><ul><li>home</li><li>about</li></ul></nav><div class=x1><p>subscribe to our letter</p></div><article><p>{}</p><p>{}</p></article><footer>all rights</footer></body>"
    rows = [(i, f"http://h{i % 2}.example/", page.format(prose(rng, "aa", 9), prose(rng, "bb", 5))) for i in range(40)] + [(100, "http://alone.example/", page.format("x", "y")), (101, "http://two.example/", page.format("p", "q")), (102, "http://two.example/", page.format("r", "s"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    by_itself = {r["page_id"]: r["text"] for r in sitetree.extract(df, hints=False).collect()}
    assert all(len(by_itself[i].split()) == 14 for i in range(40))
    # one page, or two, prove nothing; there hints decide
    assert by_itself[100] == "home about subscribe to our letter x y all rights" and by_itself[101].startswith("home")
    with_hints = {r["page_id"]: r["text"] for r in sitetree.extract(df).collect()}
    assert {i: with_hints[i] for i in range(40)} == {i: by_itself[i] for i in range(40)} and with_hints[100] == "x y"
    monkeypatch.setattr(sitetree, "BROADCAST_NODES", 0)  # each page's nodes by a join
    for hints, want in ((False, by_itself), (True, with_hints)):
        assert {r["page_id"]: r["text"] for r in sitetree.extract(df, hints=hints).collect()} == want


def test_copies_do_not_remove_the_texts_of_other_pages(spark):
    rng = random.Random(5)
    body = "<body><div class=top1><ul><li>home</li></ul></div><div class=crumbs>{}</div><div class=c><p>{}</p></div><div class=ad>{}</div></body>"
    rows = [(i, "http://s.example/", body.format(f"page {i}", "not found" if i < 60 else prose(rng, "aa", 30), prose(rng, "bb", 3))) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(len(got[i].split()) == 2 + 30 for i in range(60, 100)) and all("home" not in t for t in got.values())
    # what a host's pages differ by is not its noise: all judged by their text, this host shows too little
    same = [(i, "http://t.example/", f"<body><div><b>menu</b></div><div class=c>one text that is longer than the advert</div><div class=ad>{prose(rng, 'bb', 1)}</div></body>") for i in range(20)]
    assert {r["text"] for r in sitetree.extract(spark.createDataFrame(same, "page_id bigint, url string, html string")).collect()} == {"menu one text that is longer than the advert"}


def test_importance_is_normalised_entropy(spark):
    page = "<div class=a>same</div><div class=b>{}</div>"
    df = spark.createDataFrame([("h", page.format(i)) for i in range(8)], "host string, html string")
    found = sorted(round(r["importance"], 6) for r in sitetree.node_importance(df).collect())
    assert found == [0.0, 1.0]
    half = spark.createDataFrame([("h", page.format(i // 4)) for i in range(8)], "host string, html string")
    assert sorted(round(r["importance"], 6) for r in sitetree.node_importance(half).collect()) == [0.0, round(1 / 3, 6)]


