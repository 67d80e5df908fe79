from textloom.functions import code as K
from textloom.plans.fixtures import SNIPPETS


def features(code, language="python"):
    ok, nodes, loop, recursion, *rest = K.structure(code, language)
    return ok, loop, recursion, dict(zip(K.NAMES, rest))


def test_python_counts():
    ok, loop, recursion, f = features(SNIPPETS[1][1])
    assert ok and loop and not recursion
    assert (f["no_of_loop"], f["nested_loop_depth"], f["loop_in_loop_freq"], f["no_of_ifs"], f["cond_in_loop_freq"], f["noOfMethods"]) == (2, 2, 1, 1, 1, 1)
    assert f["cyclomatic_max"] == 5  # two loops, an if, an and
    assert features(SNIPPETS[2][1])[2] and features(SNIPPETS[2][1])[3]["recursion_present"] == 1


def test_broken_or_blank_is_zero():
    for code in ("", "   \n", SNIPPETS[3][1], None):
        ok, *_, f = features(code)
        assert not ok and set(f.values()) == {0.0}


def test_every_language_has_its_loop():
    for language, code in SNIPPETS[5:]:
        ok, loop, _, f = features(code, language)
        assert ok, language
        if language not in ("csharp",):
            assert loop and f["nested_loop_depth"] >= 1, language
        assert f["noOfMethods"] >= 1, (language, f)
    assert features(SNIPPETS[14][1], "csharp")[3]["no_of_switches"] == 1


def test_strip_python_wrapper_and_comments():
    code, was, n, ok = K.stripped(SNIPPETS[1][1], "python")
    assert was and ok and n == 1 and "class" not in code and "self" not in code and "def pairs(xs):" in code and "import heapq" in code
    assert code.count("complexity") == 0


def test_strings_and_clean_code_stay():
    assert K.stripped(SNIPPETS[4][1], "python") == (SNIPPETS[4][1], False, 0, True)
    assert K.stripped(SNIPPETS[0][1], "python") == (SNIPPETS[0][1], False, 0, True)
    assert K.without_telltales('String s = "O(n)";\nint x; // O(n) here\n', "java") == ('String s = "O(n)";\nint x;\n', 1)


def test_strip_other_languages():
    code, was, n, ok = K.stripped(SNIPPETS[5][1], "java")
    assert not was and n == 1 and ok and "Time" not in code and "class Main" in code
    code, was, n, ok = K.stripped(SNIPPETS[9][1], "ruby")
    assert was and n == 1 and ok and code.startswith("def twice") and "Solution" not in code
    code, _, n, _ = K.stripped(SNIPPETS[6][1], "cpp")
    assert n == 1 and "int n = 0;\n" in code


def test_decorators_stay_and_helpers_stay():
    source = "class TreeNode:\n    pass\n\n\nclass Solution:\n    @cache\n    def f(self):\n        return 1\n"
    code, was, _, ok = K.stripped(source, "python")
    assert was and ok and "class TreeNode" in code and "@cache\ndef f():\n    return 1" in code


def test_memory_offsets():
    code = "import os\n\n\ndef f():\n    return 1\n\n\nx = 2\n"
    raw = code.encode()
    at = K.memory_offsets(code, "python")
    assert at == [9, raw.index(b"1\n") + 1] and all(raw[i : i + 1] == b"\n" for i in at)
    assert K.memory_offsets("def f(:", "python") == [] and K.memory_offsets(None, "java") == []


def test_structure_features_make_no_copy_of_a_batch():
    """Texts of a batch stay in Arrow: what is held beside it is one text and the features."""
    import tracemalloc

    import pyarrow as pa

    code = pa.array(["def f(n):\n    return n\n# " + "x" * 50_000 + "\n", None] * 500)
    language = pa.array(["python"] * 1000)
    tracemalloc.start()
    found = K._structure(code, language)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < code.nbytes / 2 and found.field("ok").to_pylist() == [True, False] * 500 and found.field("noOfMethods").to_pylist() == [1.0, 0.0] * 500
