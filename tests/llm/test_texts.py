import random

import numpy as np
import pytest
from conftest import rows

from meshframe.llm import blocks, leak, sentences, unmarked
from meshframe.llm.words import word_spans, words

ITEM = "The ferryman of Koryor sells 226 copper lanterns before noon and keeps the résumé for his cousin"


def test_words():
    assert words("Ré­sumé_ＡＢ２ x—y 'Tis Ⅳ ﬁn") == ["resume", "ab2", "x", "y", "tis", "iv", "fin"]
    for t in ("plain_words, 12.5", "Ré­sumé ＡＢ２—fi​n ½", "日本 語。", "", "́"):
        assert len(word_spans(t)) == len(words(t))
        assert all(w in words(t[a:b]) for (a, b), w in zip(word_spans(t), words(t), strict=True))


def test_fm_index():
    rng = np.random.default_rng(2)
    for n, symbols in ((500, 5), (1, 2), (40, 2), (300, 200), (64, 3)):
        text = rng.integers(1, symbols, n)
        if n == 64:
            text = np.tile([1, 2, 1, 1], 16)  # long repeats
        order = leak.suffix_order(np.append(text, 0), symbols)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: [*text[i:], 0])
        index = leak.FMIndex(**leak.FMIndex.build(text, symbols))
        phrases = rng.integers(1, symbols, (60, 4))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(n - 3) if (text[i : i + 4] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_index_is_searched_again(spark):
    """One table of shards answers for other phrases than those it was built beside."""
    w = ITEM.split()
    shards = leak.index(spark.createDataFrame([(1, ITEM), (2, "x y " + ITEM), (3, " ".join(w[::-1]))], "doc_id bigint, text string"))
    ask = lambda text: {r.doc_id for r in leak.search(shards, spark.createDataFrame([(7, text)], "item_id bigint, text string"), False).collect()}
    assert (ask(ITEM), ask(" ".join(w[::-1])), ask("x y " + " ".join(w[:10])), ask("x " * 12)) == ({1, 2}, {3}, {2}, set())


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(leak, "SHARD", 60)
    w = ITEM.split()
    docs = [
        (1, f"Before. {ITEM}! After"),
        (2, " ".join(w[:12])),
        (3, " ".join(w[:11])),
        (4, "x " + " ** ".join(w[3:15]).upper() + " y"),
        (5, " ".join(w[:8] + ["other"] + w[8:])),
        (6, None),
        (7, ""),
        (8, "\n".join(w[2:16]).replace("é", "e").replace("lanterns", "lan​terns")),
        (9, " ".join(w) + " and " + " ".join(w)),
        (None, ITEM),
    ]
    items = [(1, ITEM), (2, "short one"), (3, " ".join(w[:13]) + " something else"), (4, None), (None, ITEM)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(1, 1), (1, 3), (2, 1), (2, 3), (4, 1), (8, 1), (9, 1), (9, 3), (None, 1), (None, 3)]
    assert rows(leak.leaks(d, e)) == sorted(want, key=repr)
    monkeypatch.setattr(leak, "BLOCK_CHARS", 10)
    assert rows(leak.leaks(d, e)) == sorted(want, key=repr)
    many = rows(leak.removal_spans(d, e))
    monkeypatch.undo()
    assert many == rows(leak.removal_spans(d, e))
    spans = {r.doc_id: r for r in leak.removal_spans(d.where("doc_id is not null"), e).collect()}
    assert docs[0][1][spans[1].start_pos : spans[1].end_pos] == ITEM and spans[1]["items"] == "1,3" and spans[1].n_words == 17
    assert leak.leaks(d.limit(0), e).isEmpty() and leak.leaks(d, e.limit(0)).isEmpty()


def test_blocks():
    t = "# Head\n\nOne line\ngoes on\n- item\n* other\n> quoted\n> again\n\n    code x = 1\n\n```py\ncode\n\ncode\n```\nafter `in` it\n<pre><code>a\n\nb</code></pre>\nlast\n~~~\nopen"
    assert [t[a:b].strip() for a, b, _ in blocks.blocks(t)] == ["# Head", "One line\ngoes on", "- item", "* other", "> quoted", "> again", "after `in` it", "last"]
    assert blocks.blocks("  \n\t") == [] and blocks.blocks("") == []


CASES = {
    "Dr. Tellow met K. M. Imbery, cf. Fig. 2 in the manual. The log says \"Done. Next.\" and stops. Is it so? We start at 9 p.m. The queue is old!": 5,
    "我用了它，结果还是空的。他说：“好了。”日志里写着“停止。请重试。”然后程序退出了。": 3,
    "หน้าจอค้าง ไฟล์ run.sh บรรทัด 9 ทำให้ช้ามาก ใช้เวลา 2.5 วินาที": 3,
    "Γιατί χάνεται; Μετά το Brindlo 0.5, η λίστα σταματά.": 2,
    "कतार क्यों टूट जाता है? डॉ. Ozmira के अनुसार नोड बंद है॥ फ़ाइल बंद है।": 3,
}


@pytest.fixture(scope="module")
def model(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return sentences.Model(sentences.train(d))


@pytest.mark.parametrize("text", CASES)
def test_units(model, text):
    got = sentences.units(text, model)
    assert len(got) == CASES[text], [text[a:b] for a, b in got]


def test_cover(spark, model):
    """Units are in order, apart, trimmed, and hold all text but code and white space."""
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect():
        at = 0
        outside = []
        for a, b in sentences.units(r.text, model):
            assert at <= a < b and r.text[a:b] == r.text[a:b].strip()
            outside.append(r.text[at:a])
            at = b
        outside.append(r.text[at:])
        text = "".join(r.text[a:b] for a, b, _ in blocks.blocks(r.text))
        kept = "".join(r.text[a:b] for a, b in sentences.units(r.text, model))
        assert "".join(text.split()) == "".join(kept.split())


TWO = "The queue is old. The graph is new."


def test_hard_texts(spark, model):
    random.seed(4)
    for t in ["", " \n ", "...", "\"(“" * 3000, "a. " * 5000, "`" * 999 + "x", "x" * 200_000, ")" * 50, "".join(random.choice("ab. \"'()\n`>-#。“”") for _ in range(20_000))]:
        got = sentences.units(t, model)
        assert all(a < b for a, b in got) and "".join(t.split()) == "".join("".join(t[a:b] for a, b in got).split()) or "`" in t or "    " in t
    d = spark.createDataFrame([(1, TWO), (1, TWO), (2, None), (3, ""), (4, " ")], "doc_id bigint, text string")
    assert rows(sentences.sentences(d, model.table)) == [(1, 0, 17)] * 2 + [(1, 18, 35)] * 2
    assert sentences.sentences(d.limit(0)).isEmpty()


def test_counts_are_exact(spark):
    """With more words than a table of fixed size holds apart, each was seen once; addresses, code and unspaced text are few words."""
    words = "array_join(transform(sequence(1, 3000), x -> translate('w' || id || 'x' || x, '0123456789', 'abcdefghij')), ' ')"
    d = spark.range(200).selectExpr("id as doc_id", f"'so ' || {words} || ' see https://a.example/' || id || ' and `c' || id || '` 我们用了它' || id || ' so' as text")
    counts = sentences.train(d)
    asked = ["Wwhxj", "Wwbjjxdaaa", "Wwunseen", "Wsee", "W我们"]
    assert {r.key: r.n for r in counts.where(counts.key.isin(asked)).collect()} == {"Wwhxj": 1, "Wwbjjxdaaa": 1, "Wsee": 200, "W我们": 200}
    assert counts.where("key like 'W%a.example%' or key like 'W%我们用%'").isEmpty()


def test_long_left_words():
    """The mark stays, and words that share 24 characters are two."""
    one, two = ("Donaudampfschifffahrtsgesell" + x for x in ("schaft.", "en."))
    lefts = [g.runs[0][1][0][1] for w in (one, two) for _, _, g in sentences.gaps(f"Die {w} Das ist neu.")]
    assert lefts == [one, two] and {sentences.left_class(x) for x in lefts} == {"\x03.C"}


def test_deep_enclosures():
    """Marks that never close don't stop later ones from enclosing."""
    text = "( " * 40 + "He said «it is done. It is new» then."
    assert sentences._enclosures(text) == [(text.index("«"), text.index("»"))]
    assert len(sentences._enclosures("(" * 5000 + ")" * 5000)) == 5000


@pytest.fixture(scope="module")
def units_of(spark):
    """Texts of sf0.01 by document, and their marked units."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    out = {i: [] for i in texts}
    for r in sentences.sentences(d).orderBy("doc_id", "start_pos").collect():
        out[r.doc_id].append((r.start_pos, r.end_pos))
    return texts, out


def test_all_gaps_without_marks(spark, units_of):
    """Held-out documents without any punctuation or case: the model finds where their sentences end."""
    texts, found = units_of
    line = {i: [x for a, e in us if texts[i][e - 1] in sentences.ENDS and (x := [w for w, *_ in unmarked.words(texts[i][a:e])])] for i, us in found.items()}
    known = spark.createDataFrame([(x,) for i, us in line.items() if i % 5 for x in us], "words array<string>")
    asked = {str(i): us for i, us in line.items() if i % 5 == 0 and 1 < len(us) and sum(map(len, us)) <= unmarked.SPAN}
    runs = spark.createDataFrame([(i, [w for x in us for w in x]) for i, us in asked.items()], "run_id string, run array<string>")
    n_true = n_found = n_both = 0
    for r in unmarked.decided(runs, unmarked.count(known)).collect():
        true = set(np.cumsum([len(x) for x in asked[r.run_id]])[:-1] - 1)
        got = {k for k, e in enumerate(r.ends) if e == "1"}
        n_true, n_found, n_both = n_true + len(true), n_found + len(got), n_both + len(true & got)
    assert n_true > 500 and n_both >= 0.9 * n_true and n_both >= 0.95 * n_found, (n_true, n_found, n_both)


def test_divide_unmarked(spark, units_of):
    """Sentences planted without marks, also in a script without spaces, come out apart; others stay as they are."""
    texts, found = units_of
    bare = lambda x: " ".join(w for w, *_ in unmarked.words(x))
    marked = [texts[i][a:e] for i, us in found.items() for a, e in us if texts[i][e - 1] in sentences.ENDS]
    short = lambda x: 20 < len(x) < 60 and "`" not in x and not any(c.isdigit() for c in x)
    latin = sorted({bare(x) for x in marked if x.isascii() and short(x)})
    han = sorted({bare(x).replace(" ", "") for x in marked if all("一" <= c <= "鿿" for c in x[:8]) and x.endswith("。") and len(x) < 40})
    random.seed(8)
    planted = {10**6 + k: random.sample(latin, 3) if k % 2 or len(han) < 3 else random.sample(han, 3) for k in range(40)}
    rows_in = [(i, t) for i, t in texts.items()] + [(i, (" " if x[0].isascii() else "").join(x)) for i, x in planted.items()]
    got = {i: [] for i, _ in rows_in}
    for r in sentences.sentences(spark.createDataFrame(rows_in, "doc_id bigint, text string"), divide_unmarked=True).orderBy("doc_id", "start_pos").collect():
        got[r.doc_id].append((r.start_pos, r.end_pos))
    right = n = units = 0
    text = dict(rows_in)
    for i, x in planted.items():
        assert "".join(text[i].split()) == "".join("".join(text[i][a:e].split()) for a, e in got[i])
        mine = [text[i][a:e] for a, e in got[i]]
        right, n, units = right + len(set(mine) & set(x)), n + 3, units + len(mine)
    assert right >= 0.85 * n and right >= 0.85 * units, (right, n, units)
    kept = sum(len(set(got[i]) & set(us)) for i, us in found.items())
    assert kept >= 0.9 * sum(map(len, found.values()))
    assert sentences.sentences(spark.createDataFrame([], "doc_id bigint, text string"), divide_unmarked=True).isEmpty()


def test_runs_cover_all_gaps(monkeypatch):
    """Long stretches are looked at in runs that share words; every gap is decided in one of them."""
    monkeypatch.setattr(unmarked, "SPAN", 7)
    monkeypatch.setattr(unmarked, "BESIDE", 2)
    for n in (2, 7, 8, 9, 40):
        line = [f"w{k}" for k in range(n)]
        gaps = []
        for first, (lo, hi), run in unmarked.runs(line):
            assert run == line[first : first + len(run)] and hi < len(run)
            gaps += range(first + lo, first + hi)
        assert gaps == list(range(n - 1))


def test_planted_boundaries(spark, model):
    """Sentences that are whole blocks of their own, put together in paragraphs: the model finds where they meet."""
    single = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text", "lang").collect():
        for a, e, g in sentences.gaps(r.text):
            bare = r.text[a:e].strip()
            if g.end and not g.runs and not g.sure and not r.text[a : e - len(g.masked)].strip() and bare[-1] in ".!?。！？" and 15 < len(bare) < 200 and "\n" not in bare:
                single.setdefault("none" if bare[-1] in "。！？" else (r.lang or "")[:2].lower(), set()).add(bare)
    random.seed(6)
    n_true = n_found = n_both = 0
    for lang, texts in sorted(single.items()):
        if len(texts) < 6:
            continue
        for _ in range(40):
            chosen = random.sample(sorted(texts), 3)
            gap = "" if lang == "none" else " "
            at, true = 0, set()
            for x in chosen:
                true.add((at, at + len(x)))
                at += len(x) + len(gap)
            got = set(sentences.units(gap.join(chosen), model))
            n_true, n_found, n_both = n_true + 3, n_found + len(got), n_both + len(true & got)
    assert n_true >= 500 and n_both >= 0.97 * n_true and n_both >= 0.97 * n_found, (n_true, n_found, n_both)
