from rivulet.llm import substrings
from tests.llm.helpers import documents, odd_texts, prose


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_passages_inside_lines_go_but_for_the_first(spark):
    passage = prose(999, 60).replace("\n", " ")
    rows = [(k, prose(k, 200)) for k in range(30)]
    for at, k in ((20, 3), (50, 11), (90, 17)):
        own = rows[k][1].split(" ")
        rows[k] = (k, " ".join([*own[:at], passage, *own[at:]]))
    got = by_id(substrings.repeats_removed(documents(spark, rows)).collect())
    assert set(got) == {11, 17}
    for k, r in got.items():
        assert r.kept_in == [3] and 40 <= r.n_removed <= 75
        assert passage not in r.text
        text, at, rest = rows[k][1], 0, []
        for span in r.removed:
            rest.append(text[at : span.start])
            at = span.end
        assert "".join([*rest, text[at:]]) == r.text
        assert any(text[s.start : s.end] in rows[k][1] for s in r.removed)


def test_copies_lines_and_stock_phrases(spark):
    stock, line = "All rights reserved here.", prose(5, 40).replace("\n", " ")
    rows = [(1, prose(1, 80)), (2, prose(1, 80).upper()), (3, f"{prose(3, 50)}\n{line}\n{line}\n{prose(4, 50)}")]
    rows += [(10 + k, f"{prose(10 + k, 40)}\n{stock}") for k in range(5)]
    got = by_id(substrings.repeats_removed(documents(spark, rows)).collect())
    assert set(got) == {2, 3}
    assert got[2].text.strip() == "" and got[2].n_removed == got[2].n_words
    assert got[3].text.count(line) == 1 and got[3].kept_in == [3]


def test_offsets_count_code_points(spark):
    passage = "Älphä bétà gämmä délta épsilon zéta êta. " * 4
    rows = [(1, "ü " + passage), (2, "ñandú ñ. " + passage + "Ende gut.")]
    got = by_id(substrings.repeats_removed(documents(spark, rows)).collect())[2]
    text, at, rest = rows[1][1], 0, []
    for span in got.removed:
        assert text[span.start : span.end] in passage
        rest.append(text[at : span.start])
        at = span.end
    assert "".join([*rest, text[at:]]) == got.text and got.text.endswith("Ende gut.")
    assert got.n_removed >= 20


def test_odd_texts_nulls_repeats_and_no_rows(spark):
    text = prose(8, 60)
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(100, text), (100, text), (None, text), (101, text), (101, text)]
    docs = documents(spark, rows).selectExpr("*", "1 AS a", "2 AS b", "3 AS unit", "4 AS earlier")
    got = substrings.repeats_removed(docs).collect()
    assert sorted(r.doc_id for r in got) == [101, 101]
    assert {tuple(r.kept_in) for r in got} == {(100,)}
    assert substrings.repeats_removed(docs.where("false")).count() == 0


def test_lines_and_passages_whose_lines_have_other_keepers(spark):
    lines = [prose(900 + k, 7).replace("\n", " ") for k in range(12)]
    rows = [(k, f"{prose(k, 40)}\n{line}\n{prose(50 + k, 40)}") for k, line in enumerate(lines)]
    passage = "\n".join(lines)
    rows += [(20 + k, f"{prose(100 + k, 40)}\n{passage}\n{prose(150 + k, 40)}") for k in range(2)]
    rows += [(30, prose(200, 40) + "\n" + lines[5] + "\n" + prose(250, 40))]
    got = by_id(substrings.repeats_removed(documents(spark, rows)).collect())
    assert set(got) == {20, 21, 30}
    assert got[21].n_removed == 84 and passage not in got[21].text and len(got[21].removed) == 1
    assert got[30].n_removed == 7 and got[30].kept_in == [5]


def test_joined_units_count_as_shared():
    keeper, size = list(range(6)), substrings.np.full(6, 4)
    closes = substrings.np.zeros(6, dtype=bool)
    assert substrings._runs(keeper, [True] * 5 + [False], size, closes, 20) == [(0, 5)]
    assert substrings._runs(keeper, [False, True] * 3, size, closes, 20) == []
