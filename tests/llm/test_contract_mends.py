"""Formulas and drawings in a line, scripts with a slash, letters without a limit, texts of marks."""

import numpy as np

from perfengine.llm import op4_html_extract as H, op6_language as L


def _texts(page):
    return [b.text for b in H.blocks(page)]


def test_formulas_and_drawings_stay_in_their_line():
    assert _texts("<p>Euler wrote that <math><mi>e</mi><mo>=</mo><mn>2</mn><annotation>e=2</annotation></math> is a number.</p>") == [
        "Euler wrote that e=2 is a number."]
    assert _texts("<p>A mark <svg viewBox='0 0 1 1'><title>icon</title><desc>an icon</desc><path d='M0 0'/><text>X</text></svg> here.</p>") == ["A mark X here."]
    assert _texts("<p>one <svg><style/><path/></svg>two</p><p>three</p>") == ["one two", "three"]


def test_an_open_formula_ends_with_its_paragraph():
    assert _texts("<p>one <math><mi>x<p>two</p><p>three</p>") == ["one x", "two", "three"]
    assert _texts("<div>one <svg><g></div><div>two</div>") == ["one", "two"]
    assert _texts("<ul><li>one <svg><li>two</ul>") == ["one", "two"]
    assert _texts("<p>a <svg><foreignObject><div>b</div></foreignObject></svg> c</p><p>d</p>") == ["a b c", "d"]


def test_a_slash_closes_no_script():
    assert _texts("<p>one</p><script/>alert(1)</script><p>two</p>") == ["one", "two"]
    assert _texts("<p>one</p><script src='x'/>") == ["one"]


def _model(**texts):
    rows = []
    for lang, text in texts.items():
        points, owner = L.code_points([text])
        letters = np.unique(points)
        _, gram, rank = L.profiles(np.searchsorted(letters, points).astype(np.int64), owner)
        for k, r in zip(gram.tolist(), rank.tolist()):
            size = k >> (L.BITS * L.ORDERS)
            cs = [(k >> (L.BITS * (size - 1 - i))) & ((1 << L.BITS) - 1) for i in range(size)]
            rows.append((lang, "".join(chr(letters[c]) if c else " " for c in cs), r))
    return L.Model(rows)


def test_any_number_of_letters():
    han = "".join(chr(0x4E00 + i) for i in range(5000))
    assert L.UNKNOWN > int((L._letters() > 0).sum())
    points, owner = L.code_points([han])
    letters = np.unique(points)
    grams, _ = L.ngrams(np.searchsorted(letters, points).astype(np.int64), owner)
    # 5,000 letters, 4,999 pairs and two with a blank, 4,998 triples and two with a blank: all differ
    assert len(letters) == 5001 and len(np.unique(grams)) == len(grams) == 5000 + 5001 + 5000
    model = _model(zh=han[:100], en="the quick brown fox jumps over the lazy dog and the cat")
    lang, score = model.score([han[:100], "the dog and the fox", None, ""] * 100)
    assert lang == ["zh", "en", "und", "und"] * 100 and score[0] == 1 and score[2] == 0


def test_marks_alone_are_no_letters():
    model = _model(en="the quick brown fox", hi="\u0915\u093f \u0939\u0948 \u092f\u0939")
    lang, score = model.score(["\u0301\u0302 \u093f", "12 !?", "\u0915\u093f", "fox\u0301"])
    assert lang == ["und", "und", "hi", "en"] and list(score[:2]) == [0, 0]
