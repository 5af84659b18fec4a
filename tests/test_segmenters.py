"""The small corpora of the survey's fixtures: containers, segmenters, containment, rendering."""

import pytest

from spanloom.operators import rendering
from spanloom.operators.segmenters import auto_number, bypass, concatenate, import_xml, intersect, merge_duplicates, parse_tag, recode, sample, select, threshold, tokenize
from spanloom.sources.corpus import from_spans, from_text, from_texts, update, with_pointers


def texts(seg):
    return [r.content for r in seg]


def anns(seg, key):
    return [(r.annotations or {}).get(key) for r in seg]


@pytest.fixture(scope="module")
def s1(spark):
    return from_text(spark, "ab cde")


@pytest.fixture(scope="module")
def word(s1):
    return from_spans(s1, [(0, 0, 2, {"a": "1"}), (0, 3, 6)], "word")


@pytest.fixture(scope="module")
def char(s1):
    return from_spans(s1, [(0, i, i + 1) for i in range(6)], "char")


@pytest.fixture(scope="module")
def letter1(s1):
    return from_spans(s1, [(0, 0, 1, {"a": "1"}), (0, 1, 2)], "letter1")


@pytest.fixture(scope="module")
def letter2(s1):
    return from_spans(s1, [(0, 3, 4), (0, 4, 5, {"b": "2"}), (0, 5, 6)], "letter2")


@pytest.fixture(scope="module")
def other(spark):
    s = from_text(spark, "abbccc", index=1)
    return from_spans(s, [(1, i, i + 1, {"a": a}) for i, a in enumerate("111223")], "other")


@pytest.fixture(scope="module")
def third(spark):
    s = from_text(spark, "bd1", index=2)
    return from_spans(s, [(2, 0, 1), (2, 1, 2, {"a": "2"}), (2, 2, 3, {"a": "b"})], "third")


def test_input(spark):
    s = from_text(spark, "ab\U0001f600c")
    assert [(r.start, r.end) for r in s] == [(0, 4)]
    assert len(from_text(spark, None)) == 0
    assert texts(update(from_texts(spark, ["x", "y"]), 1, "zz")) == ["x", "zz"]
    assert texts(update(from_texts(spark, ["x", "y"]), 0, None)) == ["y"]


def test_pointers(spark):
    s = from_texts(spark, ["x", "y"])
    p = with_pointers(s, spark.createDataFrame([(5, 1)], "str_index long, target long"))
    assert [(r.str_index, r.real_str_index, r.content) for r in p] == [(0, 0, "x"), (1, 1, "y"), (5, 1, "y")]
    for bad in ((5, 5), (5, 9), (1, 0)):
        with pytest.raises(ValueError):
            with_pointers(s, spark.createDataFrame([bad], "str_index long, target long"))


def test_container(char, word):
    assert char[1].content == "b" and char[-1].content == "e"
    assert texts(char[1:3]) == ["b", " "]
    with pytest.raises(IndexError):
        char[10]
    assert [r.annotation_key for r in word.annotation_keys().collect()] == ["a"]
    assert texts(word.append(char[0:1])) == ["ab", "cde", "a"]
    assert texts(word.set_segment(1, 3, 5)) == ["ab", "cd"]
    assert anns(word.copy({"b": "2"}), "b") == ["2", "2"]
    assert anns(word.copy(update=False), "a") == [None, None]


def test_overlap(s1, char):
    assert char.is_non_overlapping()
    assert not from_spans(s1, [(0, 3, 5), (0, 4, 6)]).is_non_overlapping()


def test_concatenate(letter1, letter2, s1):
    assert texts(concatenate([letter2, letter1])) == list("abcde")
    single = from_spans(s1, [(0, 4, 5, {"b": "1"})], "single")
    merged = concatenate([letter2, single], merge=True)
    assert texts(merged) == list("cde") and anns(merged, "b") == [None, "1", None]
    assert anns(concatenate([letter2, letter1], copy_annotations=False), "a") == [None] * 5
    assert anns(concatenate([letter2, letter1]), "component_label") == ["letter1"] * 2 + ["letter2"] * 3
    assert anns(concatenate([letter1], import_labels_as=None, auto_number_as="n"), "n") == ["1", "2"]


def test_concatenate_order(other, letter1, third):
    assert texts(concatenate([third, letter1])) == list("bd1ab")
    assert texts(concatenate([third, letter1], sort=True)) == list("abbd1")


def test_tokenize(s1, word):
    assert texts(tokenize(s1, [(r"\w+", "tokenize"), (r"\w{3,}", "tokenize")])) == ["ab", "cde", "cde"]
    got = tokenize(word, [(r"\w(\w)(\w)", "tokenize", {"&1": "&2"})])
    assert texts(got) == ["cde"] and anns(got, "d") == ["e"]
    assert texts(tokenize(s1, [(r"\W+", "split"), ("d", "split")])) == ["ab", "ab c", "cde", "e"]
    got = tokenize(word, [(r"\w+", "tokenize", {"a": "10"}), (r"\W+", "split", {"a": "20"})], merge=True)
    assert anns(got, "a")[1] == "20"
    assert texts(tokenize(word, [(r"\w", "tokenize"), ("[ae]", "tokenize")])) == list("aabcdee")
    assert anns(tokenize(word, [(r"\w+", "tokenize")], import_annotations=False), "a") == [None, None]
    with pytest.raises(ValueError):
        tokenize(s1, [(r"\w", "unknown")])


def test_select(word):
    kept, rest = select(word, r"\w{3,}")
    assert (texts(kept), texts(rest), rest.label) == (["cde"], ["ab"], "NEG_selected_data")
    assert texts(select(word, r"\w{3,}", "exclude")[0]) == ["ab"]
    assert texts(select(word, ".", annotation_key="a")[0]) == ["ab"]
    assert anns(select(word, ".", auto_number_as="n", copy_annotations=False)[0], "n") == ["1", "2"]
    with pytest.raises(ValueError):
        select(word, ".", "other")


def test_threshold(other):
    assert texts(threshold(other, 2, 2)[0]) == ["b", "b"]
    assert texts(threshold(other, 2)[0]) == list("bbccc")
    assert texts(threshold(other, max_count=2)[0]) == list("abb")
    assert texts(threshold(other)[0]) == list("abbccc")
    assert texts(threshold(other, 2, 2, "a")[0]) == ["c", "c"]
    assert texts(threshold(other, 1, annotation_key="nokey")[0]) == []


def test_sample(char):
    assert [r.start for r in sample(char, 3, "systematic")[0]] == [0, 2, 4]
    kept, rest = sample(char, 4)
    assert len(kept) == 4 and len(rest) == 2
    assert sorted(texts(kept) + texts(rest)) == sorted("ab cde")
    assert texts(sample(char, 4)[0]) == texts(kept)
    with pytest.raises(ValueError):
        sample(char, 2, "other")


def test_intersect(letter1, letter2, third):
    letter = concatenate([letter1, letter2], import_labels_as=None)
    kept, rest = intersect(letter, third)
    assert texts(kept) == ["b", "d"] and texts(rest) == ["a", "c", "e"]
    assert texts(intersect(letter, third, mode="exclude")[0]) == ["a", "c", "e"]
    assert texts(intersect(letter, third, source_key="a")[0]) == ["a"]
    assert texts(intersect(letter, third, filtering_key="a")[0]) == ["b"]
    assert texts(intersect(letter, third, "b", "a")[0]) == ["d"]


X1 = '<a attr="1"><a attr="2/3/">c<a/>d</a></a>'


@pytest.fixture(scope="module")
def xb(spark):
    return from_spans(from_texts(spark, ["<a>1<a>2<a>3</a>4", "</a>5</a>"], first_index=10), [(10, None, None, {"a": "1"}), (11, None, None)])


def test_import_xml(spark, xb):
    x1 = from_text(spark, X1)
    got = import_xml(x1, "a")
    assert texts(got) == ['<a attr="2/3/">c<a/>d</a>', "c<a/>d"] and anns(got, "attr") == ["1", "2/3/"]
    assert texts(import_xml(xb, "a")) == ["1<a>2<a>3</a>4", "2<a>3</a>4", "3", "</a>5"]
    assert texts(import_xml(x1, "a", conditions={"attr": "^2/3/$"}, remove_markup=True)) == ["c", "d"]
    assert texts(import_xml(xb, "a", remove_markup=True)) == list("122333445")
    got = import_xml(x1, "a", remove_markup=True, merge=True)
    assert texts(got) == ["c", "d"] and anns(got, "attr") == ["1", "1"]
    assert anns(import_xml(x1, "a", remove_markup=True, merge=True, preserve_leaves=True), "attr") == ["2/3/", "2/3/"]
    assert anns(import_xml(x1, "a", import_element_as="el", auto_number_as="n"), "n") == ["1", "2"]
    for bad in ("<a><a>test</a>", "<a>test</a></a>"):
        with pytest.raises(Exception, match="closing tag"):
            import_xml(from_text(spark, bad), "a").count()


def test_parse_tag():
    assert parse_tag('<x a="" b="y">') == {"element": "x", "opening": True, "empty": False, "attributes": {"a": "", "b": "y"}}
    assert parse_tag("</x>")["opening"] is False and parse_tag("<x/>")["empty"]
    assert parse_tag("<1>") is None and parse_tag("<!-- c -->") is None


def test_recode(spark, word, s1, char):
    def re(seg, **kw):
        return texts(recode(seg, **kw)[0])

    assert re(word, case="upper") == ["AB", "CDE"]
    word2 = from_spans(from_text(spark, "AB cdé"), [(0, 0, 2), (0, 3, 6)])
    assert re(word2, case="lower") == ["ab", "cdé"] and re(word2, remove_accents=True) == ["AB", "cde"]
    seg, n = recode(word, [("..", "x"), ("xe", "ex")])
    assert texts(seg) == ["x", "ex"] and n.first()[0] == 3
    assert re(word, substitutions=[("..", "x"), ("xe", "ex")], case="upper") == ["x", "xE"]
    assert re(word, substitutions=[("(.)(.)", "&2&1")]) == ["ba", "dce"]
    over = from_spans(s1, [(0, 3, 5), (0, 4, 6)])
    with pytest.raises(ValueError):
        recode(over, case="upper")
    assert re(over, case="upper", check_overlap=False) == ["CD", "DE"]
    # b and d change; the last one keeps its real string, by a pointer
    got = list(recode(char, [("[bd]", "f")])[0])
    assert got[5].real_str_index == 0 and got[5].str_index != 0 and got[0].str_index == 0
    assert got[1].str_index == got[1].real_str_index != 0


def test_merge_number_bypass(s1, third, word):
    dup = from_spans(s1, [(0, 0, 1, {"a": "1"}), (0, 0, 1, {"a": "2", "c": "3"})])
    assert anns(merge_duplicates(dup), "a") == ["2"] and anns(merge_duplicates(dup, True), "a") == ["1"]
    assert anns(merge_duplicates(dup, True), "c") == ["3"]
    assert anns(auto_number(third, "n"), "n") == ["1", "2", "3"]
    assert texts(bypass(word)) == texts(word) and bypass(word).label == "bypassed_data"


BASE = 'segment number 1\n\tcontent:\t"ab"\n\tstr_index:\t0\n\tstart:\t0\n\tend:\t2\n\tannotations:\n\t\ta                    1\n\t\tbc                   20\nsegment number 2\n\tcontent:\t"cde"\n\tstr_index:\t0\n\tstart:\t3\n\tend:\t6'


def test_rendering(s1, tmp_path, spark):
    seg = from_spans(s1, [(0, 0, 2, {"a": "1", "bc": "20"}), (0, 3, 6)])
    assert rendering.to_string(seg) == BASE
    assert rendering.to_string(seg, "%(a)s") == "1\n__none__"
    fmt = "%(__num__)s,%(__content__)s,%(__str_index__)s,%(__start__)s,%(__end__)s,%(__str_index_raw__)s,%(__start_raw__)s,%(__end_raw__)s"
    assert rendering.to_string(seg, fmt) == "1,ab,0,0,2,0,0,2\n2,cde,0,3,6,0,3,6"
    assert rendering.to_string(seg, fmt, ";", "<", ">", True) == "<1,ab,1,1,2,0,0,2;2,cde,1,4,6,0,3,6>"
    assert rendering.to_string(seg, "%(__content__)5s|100%%") == "   ab|100%\n  cde|100%"
    html, cut = rendering.to_html(seg)
    assert not cut and "Segment #1&nbsp;&nbsp;[0:0-2]" in html and '<td class="k">bc</td>' in html
    rendering.write_text(seg, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["ab", "cde"]


def test_rendering_summary(spark):
    seg = tokenize(from_text(spark, "x" * 1001), [(".", "tokenize")])
    s = rendering.to_string(seg, "%(__num__)s")
    assert s == "1\n2\n3\n4\n5\n\n[991 segments not displayed...]\n\n997\n998\n999\n1000\n1001"
    assert rendering.to_html(seg)[1]
    assert rendering.to_string(seg, "%(__num__)s", display_all=True).count("\n") == 1000
