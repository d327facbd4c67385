"""Training-data operators against brute force, round trips and held-out accuracy, edges included."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import bpe, chat, decontaminate, html, jaccard, langid, lines, quality, substrings, suffix, warc

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " \n\t ", "a", "one two", "Größe 🙂 naïve  café\n\nx" * 3, "the cat sat on the mat " * 40, "x" * 3000, "das ist gut\r\n\x0b ja"]


def words(r: random.Random, n: int, kind: str = "abcdefgh") -> str:
    return " ".join("".join(r.choices(kind, k=r.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Random texts, exact and near copies, a passage and a line that many share, the edge cases, repeated rows."""
    r = random.Random(seed)
    passage, line = words(r, 120), words(r, 30)
    out = [words(r, r.randint(20, 300)).replace(" ", "\n", 3) for _ in range(n)]
    out += [out[0], out[0], out[1]]
    near = out[2].split(" ")
    for i in range(6):
        near = list(near)
        near[r.randrange(len(near))] = f"edit{i}"
        out.append(" ".join(near))
    out += [f"{words(r, 50)}\n{passage}\n{line}\n{words(r, 30)}" for _ in range(8)]
    out += [line + "\n" + words(r, 80) for _ in range(10)]
    return list(enumerate(out + TEXTS))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_bpe_equals_the_library_and_round_trips(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    codec = bpe.load(PATH, P.PATTERN)
    assert all(codec.hash.get(t) == i for i, t in enumerate(codec.tokens)) and codec.hash.get(b"no such token at all") == -1
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = sorted((d, len(i := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs[0])
    assert rows(bpe.digest(docs[1], PATH, P.PATTERN)) == want
    odd = ["a" * 5000, "\x1c \x85 　x", "½²٣ 日本語🙂🙂", "'s 'll don't"]
    assert [codec.encode(t) for t in odd] == [enc.encode_ordinary(t) for t in odd]
    # pieces too long for packed heap entries merge alike
    r = random.Random(8)
    for n in (1, 2, 3, 50, 400, 3000):
        piece = "".join(r.choices("etaoin shrd", k=n)).encode()
        assert codec._merge_long(piece) == codec.merge(piece)
    clash = spark.createDataFrame([(1, "ab", [9], b"z")], "id int, text string, ids array<int>, decoded binary")
    got = bpe.decode(bpe.encode(clash, PATH, P.PATTERN), PATH, P.PATTERN).first()
    assert bytes(got.decoded) == b"ab" and bpe.encode(docs[1].limit(0), PATH, P.PATTERN).collect() == []


def test_chat_spans_and_rewrites(spark):
    talk = [(1, 0, "user", "hi ### x </turn> \\h"), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (2, None, None, None), (None, 0, "assistant", "")]
    talk += [(3, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(50)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    turns = "".join(f"{r}\n{t}\n" for _, _, r, t in talk[:3])
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].loss_chars == 4
    assert got[3].n_turns == 50 and got[3].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 50, 2)).encode()).hexdigest()
    assert got[2].n_turns == 1 and got[None].loss_chars == 0 and not any(r.rewrites_history for r in got.values())

    class Forgetful(chat.MarkedTemplate):
        def __call__(self, turns):
            return super().__call__([(r, "(gone)" if i < len(turns) - 2 else t) for i, (r, t) in enumerate(turns)])

    assert chat.spans(df.where("conv_id = 3"), Forgetful()).where("rewrites").count() > 0
    last = chat.Renderer(lambda turns: ("!" if len(turns) > 20 else "") + "".join(t for _, t in turns))
    assert [i for i in range(30) if last.add(("user", "x")).rewrites] == [20]
    # a template that numbers its turns rewrites nothing, at any length
    numbered = chat.Renderer(lambda turns: "".join(f"{i}: {t}\n" for i, (_, t) in enumerate(turns)))
    spans = [numbered.add(("user", f"x{i}")) for i in range(200)]
    assert [x.text for x in spans] == [f"{i}: x{i}\n" for i in range(200)] and [x.text[x.lo : x.hi] for x in spans] == [f"x{i}" for i in range(200)] and not numbered.rewrites
    assert chat.conversations(df.limit(0)).collect() == []


def test_warc_round_trip(spark):
    pages = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, "http://b/\r\nX: y", "other é"), (4, None, None), (5, "u", ""), (6, "u", "x" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.result(df).collect()}
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[1].refers_to is None and got[5].refers_to == 4
    import base64

    assert got[2].payload_digest == base64.b32encode(hashlib.sha1("other é".encode()).digest()).decode() and got[6].payload_bytes == 100_000
    archive = warc.write(df)
    assert archive.payloads.count() == 4
    full = {r.record_id: bytes(r.record) for r in warc.records(archive, full=True).collect()}
    assert full[3].endswith(b"same\r\n\r\n") and b"\nX: y" not in full[2]
    assert all(r.record_type == "response" for r in warc.parse(warc.records(warc.write(df, min_bytes=10))).collect() if r.payload_bytes < 10)
    bad = warc.records(archive).where("record_id = 2").first()
    with pytest.raises(ValueError):
        warc.split_record(bytes(bad.record)[:-6])
    assert warc.result(df.limit(0)).collect() == []


def test_decontamination_equals_brute_force(spark, docs):
    r = random.Random(1)
    some = dict(docs[0])
    items = [(1, " ".join(some[4].split()[3:30]).upper()), (2, "one two"), (3, some[70]), (4, None), (5, "..."), (6, words(r, 40)), (7, "the cat sat on the mat"), (7, "the cat sat on the mat")]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.report(docs[1], df)) == sorted(decontaminate.brute_force(docs[0], items))
    assert {r.n_hit for r in decontaminate.report(docs[1], df.limit(0)).collect()} == {0}
    assert decontaminate.report(docs[1].limit(0), df).collect() == []


def test_quality_measures(spark):
    texts = [None, "", "a b c a b c a b c", "x\nx\n\nx", "#$ <b> 𝒳!", "The of and to " * 30, "word " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.result(df).collect()}
    assert (got[2].n_words, got[2].n_repeat_words) == (9, 9) and got[3].n_dup_lines == 2
    assert (got[4].n_symbols, got[4].word_chars) == (4, 7) and got[0].n_words == got[1].n_words == 0 and got[0].base_failed
    assert got[6].base_failed and not got[6].kept
    assert quality.result(df.limit(0)).collect() == []


def test_suffix_sorting_and_prefixes():
    g = np.random.default_rng(2)
    for _ in range(200):
        n, depth = int(g.integers(1, 80)), int(g.integers(1, 14))
        s = g.integers(0, int(g.integers(2, 6)), n)
        sa = suffix.suffix_array(s, depth)
        keys = [tuple(s[i : i + depth]) for i in sa]
        assert sorted(sa.tolist()) == list(range(n)) and keys == sorted(keys)
        seen = {}
        for i in range(n - depth + 1):
            seen.setdefault(tuple(s[i : i + depth]), []).append(i)
        want = {i for k, v in seen.items() if len(v) > 1 and 0 not in k for i in v}
        assert set(np.flatnonzero(suffix.repeated(s, depth)).tolist()) == want


def test_substrings_equal_brute_force(docs, monkeypatch):
    assert rows(substrings.result(docs[1])) == sorted(substrings.brute_force(docs[0]))
    assert substrings.result(docs[1].limit(0)).collect() == []


def test_large_groups_split_without_loss():
    g = random.Random(4)
    shared = bytes(g.choices(b"abc", k=230))
    group = []
    for i in range(700):
        left, right = bytes(g.choices(b"xyz", k=180)), bytes(g.choices(b"xyz", k=300))
        group.append((i, left + shared + right, 180 + 15))
    group[5] = (5, group[4][1][:100] + b"q" + group[4][1][101:], 195)
    found = {(row[0][0]) for part in substrings._split(group, 400, 0, 195, 200) for row in [(part[k], a, b) for k, a, b in substrings._sort_group(part, 400).tolist()]}
    assert found == {4, 5}


@pytest.mark.parametrize("n", [700, 2100])
def test_large_groups_equal_brute_force(spark, n):
    g = random.Random(n)
    passage = words(g, 400)[:450]
    texts = [(i, words(g, 60) + passage + words(g, 60)) for i in range(n)]
    # near copies that agree with their neighbours to one side, and a passage cut below and above the span
    texts += [(n + i, words(g, 90) + t[-480:]) for i, (_, t) in enumerate(texts[:5])]
    texts += [(n + 5 + i, words(g, 90) + passage[i * 26 : 425]) for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert rows(substrings.result(df)) == sorted(substrings.brute_force(texts))


def test_jaccard_equals_brute_force(docs):
    assert rows(jaccard.join(docs[1])) == sorted(jaccard.brute_force(docs[0]))
    assert rows(jaccard.join(docs[1], 5, 80)) == sorted(jaccard.brute_force(docs[0], 5, 80))
    assert jaccard.join(docs[1].limit(0)).collect() == []


@pytest.mark.parametrize("seed, part", [(1, 2048), (2, 64)])
def test_jaccard_of_large_families_equals_brute_force(spark, monkeypatch, seed, part):
    """Families whose members are near the threshold to each other, larger than a small tile and than a banded one."""
    r = random.Random(seed)
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "FAMILY", 4 * part)
    texts = []
    for n, size in ((330, 90), (90, 60), (20, 200)):
        base = words(r, size, "abcdefghijkl").split(" ")
        for _ in range(n):
            own = list(base)
            for _ in range(r.randint(0, max(2, size // 25))):
                own[r.randrange(size)] = words(r, 1, "mnopqrst")
            texts.append(" ".join(own[: r.randint(size - 6, size)]))
    data = list(enumerate(texts))
    r.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert rows(jaccard.join(df)) == sorted(jaccard.brute_force(data))


def test_one_of_each_component_stays(spark):
    r = random.Random(6)
    a, b, c = (words(r, 60) for _ in range(3))
    data = [(1, a, "x"), (2, a + " z", "x"), (2, b, "x"), (None, c, "x"), (None, c, "y"), (5, c, "x"), (7, None, "x"), (7, "", "x"), (7, "", "y"), (8, a, "x"), (1, a, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, key string")
    left = sorted(((x.doc_id, x.text) for x in jaccard.one_of_each(df, 5, 80).collect()), key=str)
    assert left == sorted([(1, a), (2, b), (5, c), (7, None), (7, ""), (7, "")], key=str)
    assert jaccard.one_of_each(df.limit(0)).collect() == []


def test_line_dedup_keeps_first_occurrences(spark, docs):
    r = random.Random(9)
    block = "\n".join(words(r, 6) for _ in range(40))
    texts = [f"{words(r, 5)}\n{block}\n{words(r, 5)}" for _ in range(5)] + ["alone\nhere", None, "", "\n\n", "a\n\nb"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    got = {x.doc_id: x for x in lines.dedup(df).collect()}
    assert got[0].text == texts[0] and got[0].n_removed_lines == 0 and all(got[i].text == texts[i] for i in range(5, 10))
    for i in range(1, 5):
        left = got[i].text.split("\n")
        assert len(left) == got[i].n_lines - got[i].n_removed_lines and got[i].n_removed_lines >= 20
        assert left[0] == texts[i].split("\n")[0] and left[-1] == texts[i].split("\n")[-1]
    assert {x.doc_id: x.text for x in lines.dedup(docs[1]).collect()} == dict(lines.brute_force(docs[0]))
    assert lines.result(docs[1].limit(0)).collect() == []


def test_line_dedup_of_long_texts_equals_brute_force(spark):
    r = random.Random(13)
    long = [words(r, 8) for _ in range(300)]
    texts = ["\n".join(x) for x in (["same"] * 130, long, long, [words(r, 8), *long], long[:150] + [words(r, 8)] + long[150:], [x for y in long[:90] for x in (y, "")], long[40:], long[:7] * 12, ["", "", long[3], "", long[4]])]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lines.dedup(df).collect()}
    assert {k: x.text for k, x in got.items()} == dict(lines.brute_force(data))
    assert {x.doc_id: x.text for x in lines.dedup(df, 5).collect()} == dict(lines.brute_force(data, 5))
    # near copies stay whole where only half of a text may go, whole copies still go
    half = {x.doc_id: x for x in lines.dedup(df, most=50).collect()}
    assert half[2].text == "" and half[3].text == texts[3] and half[3].n_removed_lines == 0
    # a whole copy goes, and of one with a line on top or amid no more than a few lines stay, wherever they are
    assert (got[1].n_removed_lines, got[2].n_removed_lines, got[2].text) == (0, 300, "")
    assert all(301 - got[i].n_removed_lines <= 9 for i in (3, 4))
    # no line is lost from the corpus
    every, left = ({y for x in t for y in x.split("\n")} for t in (texts, [x.text for x in got.values()]))
    assert every - {""} == left - {""}


def test_boundaries_follow_from_the_lines_around_them():
    import pyarrow as pa

    r = random.Random(3)
    text = [words(r, 6) for _ in range(500)]
    one, two = (lines.Chunks(pa.array(["\n".join(x)], pa.string())) for x in (text, [words(r, 6), *text]))
    a, b = ({c.text(i) for i in range(len(c.head))} for c in (one, two))
    assert len(a - b) <= 3 and len(b - a) <= 4 and min(one.tail - one.head) >= 2


def test_line_dedup_of_short_passages(spark):
    r = random.Random(14)
    passages = ["\n".join(words(r, 12) for _ in range(5)) for _ in range(200)]
    texts = [(j * 1000 + i, "\n".join([*(words(r, 9) for _ in range(3)), p, *(words(r, 9) for _ in range(3))])) for j in range(2) for i, p in enumerate(passages)]
    got = lines.dedup(spark.createDataFrame(texts, "doc_id long, text string")).where("doc_id >= 1000").agg(F.sum("n_removed_lines"), F.max("n_removed_lines")).first()
    # of five repeated lines amid own text, with no more than those gone
    assert got[0] >= 0.6 * 5 * 200 and got[1] <= 5


def test_html_blocks_and_hosts(spark):
    page = '<!doctype html><html><head><title>t</title><script>var a="</p><article>";</script></head><body><nav>menu</nav><header>top</header><article class="post"><h1>A &amp; B</h1><p>one <b>two<br>three<p>fo&#117;r\n\t five<div class="ad">buy</div><aside>x</aside><form>y</form><ul><li>l1<li>l2</ul><section id="comments"><p>nice</p></section></article><footer>&copy;</footer>'
    bare = [f"<body><div>site wide menu of the shop with many words</div><div>unique text number {i} {'abcdefgh'[i]} lives here only {i * 7}</div></body>" for i in range(6)]
    data = [(0, "http://h/1", page), (1, None, None), (2, "u", ""), *((10 + i, f"https://Shop.example:80/{i}", b) for i, b in enumerate(bare)), (10, "https://Shop.example:80/0", bare[0])]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in html.result(df).collect()]
    text = dict(got)
    assert text[0] == "A & B\n\none two three\n\nfour five\n\nl1\n\nl2" and text[1] == text[2] == "" and len(got) == 10
    assert all("site wide" not in text[10 + i] and f"number {i}" in text[10 + i] for i in range(6))
    assert html.result(df.limit(0)).collect() == []


def test_html_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    menu, inside, passage = words(r, 14), words(r, 9), words(r, 20)
    data = []
    for i in range(60):
        host = "abc"[i % 3]
        box = f"<p>{inside}</p>" if i % 3 == 0 or i % 7 == 0 else ""
        shared = f"<p>{passage}</p>" if i % 5 == 0 else ""
        open_, close = ("<article>", "</article>") if i % 2 else ("<div>", "</div>")
        data.append((i, f"http://{host}/{i}", f"<div>{menu} {words(r, 2)}</div>{open_}<p>{words(r, r.randint(1, 40))}</p>{box}{shared}{close}<div>{words(r, 4)}</div>"))
    data += [(90 + i, "http://a/x", data[0][2]) for i in range(9)] + [(99, None, "<p>x"), (100, "http://d/1", data[1][2]), (101, "http://d/2", data[1][2] + "y")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)
    want = sorted(html.brute_force(data))
    got = html.extract(df).select("page_id", "text")
    assert rows(got) == want
    # the passage that a fifth of a host's articles share stays, the box that most of host a's have goes
    texts = dict(want)
    assert passage in texts[5] and inside not in texts[3] and inside in texts[7] and all(menu not in t for t in texts.values())
    monkeypatch.setattr(html, "MOST_GRAMS", 0)
    monkeypatch.setattr(html, "MOST_HOSTS", -1)
    assert rows(html.extract(df).select("page_id", "text")) == want
    # dealt out over shards the host still decides; only runs that are rare in a shard aren't counted there
    monkeypatch.setattr(html, "SHARD", 10)
    texts = dict(rows(html.extract(df).select("page_id", "text")))
    assert passage in texts[5] and inside not in texts[3] and inside in texts[7] and all(menu not in t for t in texts.values())


def test_malformed_html_takes_linear_time():
    import time

    n = 1 << 20
    for piece in ("<", "<a", "<a b=\"", "<!--", "<b>", "</b>", "<i></b>", "<![CDATA[", "<script>", "&", "<p class='", "<div a='x>"):
        began = time.time()
        html.blocks("start " + piece * (n // len(piece)))
        html.blocks(piece + " " * n)
        assert time.time() - began < 20, piece
    assert html.blocks("a < b <p>c<1 & d</p><!-- x") == [(0, "a < b"), (0, "c<1 & d")]


def test_language_id(spark):
    r = random.Random(2)
    vocab = {"aa": ["the", "thing", "with", "other"], "bb": ["der", "nicht", "schön", "auch"], "cc": ["que", "élève", "dans", "aux"]}
    data = [(i, " ".join(r.choices(vocab[k], k=r.randint(5, 90))), k) for i, k in enumerate(r.choices(list(vocab), k=300))]
    df = spark.createDataFrame(data + [(900, None, "aa"), (901, "12 !?", None), (902, "", "zz"), (None, "the thing", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {x.doc_id: x for x in langid.predict(df, model).join(df.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()}
    assert np.mean([x.lang_pred == x.truth for i, x in got.items() if i < 300]) > 0.99 and all(0 <= x.score <= 1 for x in got.values())
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und"
    assert [k for _, k, _ in langid.label_words("the thing der schön", model)] == ["aa", "aa", "bb", "bb"]
    assert {x.lang_pred for x in langid.result(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.result(df.limit(0)).collect() == []
    # whatever the number of rows, some are taken
    assert langid.share_below(350, 10**10) * 10**10 // langid._SPACE in (349, 350) and langid.share_below(350, 10) == langid._SPACE
    # a language of one repeated, very long text is learned, and so is one of very many
    many = [(i, "αβγ δεζ " * 6000, "gr") for i in range(40)] + [(1000 + i, " ".join([chr(0x4E00 + i)] * 9), f"l{i}") for i in range(40)]
    odd = spark.createDataFrame(data + many, "doc_id long, text string, lang string")
    model = langid.train(odd)
    assert len(model.langs) >= 34 and {"aa", "bb", "cc", "gr"} <= set(model.langs)
    assert langid.predict(spark.createDataFrame([("δεζ αβγ", 1.0, 1)], "text string, _lowered double, score int"), model).first().lang_pred == "gr"


def test_forward_backward_equals_enumeration():
    import itertools

    g = np.random.default_rng(1)
    e, trans, start = g.normal(size=(5, 3)), g.normal(size=(3, 3)), g.normal(size=3)
    p, pairs = langid.forward_backward(e, np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 1]), trans, start, pairs=True)
    want, both = np.zeros((5, 3)), np.zeros((3, 3))
    for lo, n in ((0, 3), (3, 2)):
        total = 0
        one, two = np.zeros((5, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=n):
            w = np.exp(start[y[0]] + sum(e[lo + i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            for i, k in enumerate(y):
                one[lo + i, k] += w
            for a, b in zip(y, y[1:], strict=False):
                two[a, b] += w
        want += one / total
        both += two / total
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_extra_columns_with_clashing_names(spark):
    """Columns named like those that operators use inside stay as they are."""
    names = ["k1", "k2", "key", "gone", "comp", "h", "n", "place", "_key", "_text", "_lo", "_hi", "_w", "_l", "_host", "_html", "_grams", "_lowered", "__key", "a", "b", "token"]
    text = "a b c d e f\ng h i j k\nl m n"
    docs = spark.createDataFrame([(1, text, *names), (2, text, *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    model = langid.Model([], np.zeros((1 << langid.WEIGHT_BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    pages = docs.withColumn("url", F.lit("http://h/")).withColumn("html", F.col("text"))
    for got in (substrings.remove(docs), lines.dedup(docs), quality.apply(docs), langid.predict(docs, model), html.extract(pages), jaccard.one_of_each(docs), bpe.encode(docs, PATH, P.PATTERN)):
        found = got.select(*names).collect()
        assert len(found) in (2, 3) and all(tuple(x) == tuple(names) for x in found)


def test_steps_bound_the_memory_of_a_worker():
    import tracemalloc

    import pyarrow as pa

    from halyard.llm import common

    r = random.Random(9)
    texts = [words(r, 400).replace(" ", "\n", 40) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 3 << 20
    model = langid.fit(texts[:4], ["a", "b", "c", "d"], epochs=1)
    for run in (model.predict, lambda col: jaccard.Sets(col, 5), lambda col: lines.Chunks(col, 4)):
        tracemalloc.start()
        n = sum(part.num_rows for part in common.steps(batch) if run(part.column("text")))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == len(texts)
        assert most < 80 << 20, (run, most >> 20)
