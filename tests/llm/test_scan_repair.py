import pytest

from lodestrata.llm.scan_repair import STATES, LineModel, corrections, features, labelled_pages, line_model, read_number, read_text, recase, repair_events, repaired_paragraphs, variants


def test_held_out_lines():
    """Pages of another seed: nine lines in ten or more get their state, and nearly all furniture is found."""
    model = LineModel(labelled_pages(120, seed=5))
    right = total = found = furniture = 0
    for page in labelled_pages(40, seed=77):
        got = [STATES[s] for s in model.label([line for line, _ in page])]
        right += sum(g == w for g, (_, w) in zip(got, page))
        total += len(page)
        found += sum(g == w == "furniture" for g, (_, w) in zip(got, page))
        furniture += sum(w == "furniture" for _, w in page)
    assert right / total > 0.95 and found / furniture > 0.9, (right / total, found / furniture)


@pytest.mark.parametrize("token,want", [("192B", "1928"), ("2o8.5", "208.5"), ("I989", "1989"), ("8O3", "803"), ("1989", None), ("SH-17", None), ("O2", None), ("ho1e", None), ("", None)])
def test_numbers(token, want):
    assert read_number(token) == want


def test_variants_and_case():
    assert "clay" in variants("c1ay") and "minerals" in variants("rninerals") and "with" in variants("vvith") and variants("x" * 50) == {}
    assert recase("5outh", "south", True) == "South" and recase("5outh", "south", False) == "south" and recase("CEMENTATl0N", "cementation", False) == "CEMENTATION"


def test_words_join_over_furniture():
    text = "The rhyolite of the upper member is cut by late veins, and spot anal-\nJ. Basin Metals 24 | 617\nDownloaded by guest on 3 March 2016\n\nyses show that along the northern fault of the hill the fine-\ngrained ore of the vein is rich in zinc and\nlead along the northern fault of the hill.\n"
    lines = {n: (s, [w for w, _ in words], splits) for n, s, words, splits in read_text(text, line_model())}
    assert lines[2][0] == lines[3][0] == "furniture"
    assert lines[1][2] == [("anal-", "yses")] and "yses" not in lines[5][1] and lines[5][2] == [("fine-", "grained")]


S = "content_id bigint, doc_id string, file_name string, n_pages int, full_text string, marker_markdown string, relevant_paragraphs array<struct<paragraph:string,score:double>>, field string"


def test_events(spark):
    body = "Grades decline along the fault and the chlorite is found in the vein.\nThe fine-grained sphalerite occurs with chlorite along the fault.\nAnalyses of the chlorite were made in the laboratory.\n"
    rows = [(i, None, "f", 1, body, None, None, "clash") for i in range(12)]
    bad = "Grades decline a1ong the fault and the cblorite in 192B is found in anal-\nyses of the fine-\ngrained sphalerite with chlor­\nite along the fault.\n180\n"
    rows += [(90, None, "f", 1, bad, "", [(None, 0.1), ("Chlorite occurs with sphalerite a1ong the fault of the vein.", None)], "c"), (91, None, "f", 1, None, None, None, "c"), (91, None, "f", 1, "", " \n", [], "c")]
    got = sorted((r.content_id, r.field, r.pos, r.line_no, r.kind, r.fixed) for r in repair_events(spark.createDataFrame(rows, S)).collect())
    assert got == [
        (90, "full_text", 0, 1, "broken_word", "analyses"), (90, "full_text", 0, 1, "misread", "1928"), (90, "full_text", 0, 1, "misread", "along"), (90, "full_text", 0, 1, "misread", "chlorite"),
        (90, "full_text", 0, 3, "broken_word", "chlorite"), (90, "full_text", 0, 5, "furniture", ""), (90, "paragraph", 2, 1, "misread", "along"),
    ]


def test_empty(spark):
    assert repair_events(spark.createDataFrame([], S)).count() == 0
    assert corrections(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_table_cells_are_no_page_numbers():
    text = "Table 3. Spot results, n = 3\n180\n226\n52\n\nResults\n\nThe ore is hosted by schist along the fault of the hill.\n615\n"
    x = features(text.split("\n"))
    states = [STATES[s] for s in line_model().label(text.split("\n"))]
    assert len(x) == len(states) and states[1:4] == ["cell"] * 3 and states[8] == "furniture"


def test_paragraphs(spark):
    """The running text comes out whole: over furniture, with words mended and corrected, paragraph by paragraph."""
    body = "Grades decline along the fault and the chlorite is found in the vein.\nThe fine-grained sphalerite occurs with chlorite along the fault.\nAnalyses of the chlorite were made in the laboratory.\n"
    rows = [(i, None, "f", 1, body, None, None, "clash") for i in range(24)]
    bad = (
        "RESULTS\n\nGrades decline a1ong the fault (and the cblorite) in 192B is found in anal-\nJ. Basin Metals 24 | 617\nDownloaded by guest on 3 March 2016\n\nyses of the fine-\n"
        "grained sphalerite with chlor­\nite, along the fault of the hill.\n\nThe second part of the text is about the vein and\nthe fault of the hill.\n"
    )
    rows += [(None, None, "f", 1, bad, "", [(None, 0.1), ("Chlorite occurs with sphalerite a1ong the fault of the vein.", None)], "c")] * 2 + [(91, None, "f", 1, None, " \n", [], "c")]
    df = repaired_paragraphs(spark.createDataFrame(rows, S))
    got = sorted((r.field, r.pos, r.paragraph_no, r.text) for r in df.where("content_id IS NULL").collect())
    assert df.columns == ["content_id", "field", "pos", "paragraph_no", "text"] and df.where("content_id = 91").count() == 0
    assert got == [
        ("full_text", 0, 1, "Grades decline along the fault (and the chlorite) in 1928 is found in analyses of the fine-grained sphalerite with chlorite, along the fault of the hill."),
        ("full_text", 0, 2, "The second part of the text is about the vein and the fault of the hill."),
        ("paragraph", 2, 1, "Chlorite occurs with sphalerite along the fault of the vein."),
    ]
    assert df.where("content_id = 1").first().text == body.strip().replace("\n", " ")


def test_corrections_follow_ratios_not_corpus_size(spark):
    words = [("antimony", 16), ("anfimony", 1), ("klelrknevmia", 1), ("kleirknevmia", 9), ("goethite", 2), ("gocthite", 1), ("sph@lerite", 1), ("sphalerite", 1)]
    for times in (1, 50):
        c = spark.createDataFrame([(w, n * times) for w, n in words], "word string, n bigint")
        assert {r.word: r.fixed for r in corrections(c).collect()} == {"anfimony": "antimony", "klelrknevmia": "kleirknevmia", "sph@lerite": "sphalerite"}


def test_long_words_are_corrected_as_well(spark):
    """Words over 40 letters, or with many a 1, meet others on hashes: every one-confusion variant is found, and nothing else."""
    from lodestrata.llm.scan_repair import folded_changes, folded_keys

    long = "dichloro" * 6 + "ethane"
    for a, b in (("cl", "d"), ("h", "li"), ("m", "rn"), ("e", "c")):
        w = "x" * 20 + a + long
        assert set(folded_keys("x" * 20 + b + long, False)) & set(folded_keys(w, True)) and folded_changes(w, "x" * 20 + b + long) == 1
    assert folded_changes(long, "y" + long) == -1 and folded_changes("1llllll1", "illllllli"[:8]) >= 1
    rows = [(long, 300), (long.replace("eth", "etb"), 1), ("mi11i1i1i1i1m", 1), ("millililililm", 400), ("q" * 60, 5)]
    c = spark.createDataFrame(rows, "word string, n bigint")
    assert {r.word: r.fixed for r in corrections(c).collect()} == {long.replace("eth", "etb"): long, "mi11i1i1i1i1m": "millililililm"}
