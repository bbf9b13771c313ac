"""Comments, strings and brackets against slow scanners, on random texts."""

import random

import pytest

from graphloom.sources import scanner

MARKS = ["'", '"', "`", "/", "*", "//", "/*", "*/", "\n", "{", "}", "${", "\\", "r", "#", "a", " ", "(", ")", "'''", '"""', "<!--", "-->", "😀", "b", "!", "=", ","]


def slow_go(text):
    """One character at a time: blanks Go's comments and strings."""
    out, i, n = list(text), 0, len(text)

    def wipe(a, b):
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        begin = i
        if text.startswith("//", i):
            while i < n and text[i] != "\n":
                i += 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
        elif text[i] == '"':
            i += 1
            while i < n and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
            i = min(n, i + 1)
        elif text[i] == "`":
            end = text.find("`", i + 1)
            i = n if end < 0 else end + 1
        elif text[i] == "'" and i + 2 < n and text[i + 1] not in "'\\\n" and text[i + 2] == "'":
            i += 3
        elif text[i] == "'" and i + 3 < n and text[i + 1] == "\\" and text[i + 2] not in "\nxuU01234567" and text[i + 3] == "'":
            i += 4
        else:
            i += 1
            continue
        wipe(begin, i)
    return "".join(out)


def slow_nested(text):
    """Rust's nested comments alone."""
    out, depth, i = list(text), 0, 0
    while i < len(text):
        if text.startswith("/*", i):
            depth, step = depth + 1, 2
        elif depth and text.startswith("*/", i):
            depth, step = depth - 1, 2
            out[i : i + 2] = "  "
        else:
            step = 1
        if depth:
            for k in range(i, min(i + step, len(text))):
                if out[k] != "\n":
                    out[k] = " "
        i += step
    return "".join(out)


@pytest.mark.parametrize("language", ["script", "vue", "go", "dart", "rust"])
def test_length_and_newlines_stay(language):
    r = random.Random(language)
    for _ in range(3000):
        text = "".join(r.choice(MARKS) for _ in range(r.randint(0, 30)))
        spans = scanner.noise(text, language)
        assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        for strings in (False, True):
            out = scanner.blank(text, spans, strings)
            assert len(out) == len(text) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
            assert all(a in (b, " ") for a, b in zip(out, text, strict=True))


def test_go_against_a_slow_scanner():
    r = random.Random(2)
    marks = ["'", '"', "`", "/", "*", "//", "/*", "*/", "\n", "\\", "a", " ", "n", "{"]
    for _ in range(20_000):
        text = "".join(r.choice(marks) for _ in range(r.randint(0, 16)))
        assert scanner.blank(text, scanner.noise(text, "go"), True) == slow_go(text), text


def test_nested_comments_against_a_slow_scanner():
    r = random.Random(3)
    for _ in range(5000):
        text = "".join(r.choice(["/*", "*/", "*", "a", "\n", " ", "b"]) for _ in range(r.randint(0, 20)))
        if "//" in text:  # a line comment
            continue
        assert scanner.blank(text, scanner.noise(text, "rust"), True) == slow_nested(text), text


@pytest.mark.parametrize(
    ("language", "text", "bare"),
    [
        ("script", "a = `x ${b + `q${c}` + {d:1}} y`; // z", "a =      b +     c   + {d:1}    ;     "),
        ("script", "r = /a\\/[/]'\"/g; x = a / b / c;", "r =            ; x = a / b / c;"),
        ("script", "<p>Don't</p> 'x' http://a", "<p>Don't</p>     http://a"),
        ("rust", "fn f<'a>(x: &'a str) { let c = 'x'; r#\"a \"q\" b\"# }", "fn f<'a>(x: &'a str) { let c =    ;              }"),
        ("dart", "s = 'a ${b['c']} d'; r'\\'; '''x'y'''", "s =      b[   ]    ;     ;          "),
        ("vue", "<!-- a --><b/> /* c */", " " * 10 + "<b/>" + " " * 8),
    ],
)
def test_languages(language, text, bare):
    assert scanner.blank(text, scanner.noise(text, language), True) == bare


def slow_pairs(text):
    out = []
    for opens, closes in scanner.BRACKETS:
        stack, found = [], []
        for i, c in enumerate(text):
            if c == opens:
                stack.append(i)
            elif c == closes and stack:
                found.append((stack.pop(), i))
        out.append(sorted(found))
    return out


def test_pairs_against_a_stack():
    r = random.Random(4)
    for _ in range(20_000):
        text = "".join(r.choice("(){}[]a\n") for _ in range(r.randint(0, 24)))
        assert [[(int(a), int(b)) for a, b, _ in found] for found in scanner.pairs(text)] == slow_pairs(text), text


def test_long_texts():
    for language in ("script", "vue", "go", "dart", "rust"):
        for text in ('"' + "a" * 1_000_000 + '"', '"' + "\\n" * 500_000, "/*" * 300_000, "{" * 500_000, "`${" * 50_000):
            assert len(scanner.blank(text, scanner.noise(text, language), True)) == len(text)


def test_a_file_that_fails_leaves_the_others(spark, monkeypatch):
    df = spark.createDataFrame([("a.ts", "ts", "x // y"), ("b.ts", "ts", "bad �"), ("c.go", "go", None)], "path string, ext string, content string")
    rows = {r.path: r for r in scanner.scanned(df).collect()}
    assert rows["a.ts"].code == "x     " and rows["a.ts"].error is None and rows["b.ts"].error == "not UTF-8" and rows["c.go"].bare == ""
