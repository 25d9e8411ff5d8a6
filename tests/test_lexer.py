"""What is code and what is not: texts put together from known pieces, and definitions amid misleading strings and comments."""

import random

import pytest

from lodestone.operators import lexer, parse

NOISE = ["} function no() {", "def no", "{{", "fn no() {", "class No {", "end", "// x", "( ["]
# For each language: openings and closings that may hold any noise on one line, by kind.
WRAPS = {
    "c": [("comment", "/* ", " */"), ("string", '"', '"'), ("string", 'R"x(', ')x"'), ("comment", "// ", "\n"), ("directive", "\n#define X ", "\n")],
    "java": [("comment", "/* ", " */"), ("string", '"', '"'), ("string", '"""\n', '"""'), ("comment", "// ", "\n")],
    "c_sharp": [("comment", "/* ", " */"), ("string", '"', '"'), ("string", '@"', '""\n"'), ("comment", "// ", "\n")],
    "javascript": [("comment", "/* ", " */"), ("string", '"', "\\\"\""), ("string", "'", "'"), ("string", "`\n", "`"), ("comment", "// ", "\n"), ("regex", "/[/", "]/")],
    "go": [("comment", "/* ", " */"), ("string", '"', '"'), ("string", "`\n", "`"), ("comment", "// ", "\n")],
    "rust": [("comment", "/* /* ", " */ */"), ("string", '"', '"'), ("string", 'r##"', '"# "##'), ("comment", "// ", "\n")],
    "ruby": [("comment", "# ", "\n"), ("string", '"', '\\""'), ("string", "'", "'"), ("comment", "\n=begin\n", "\n=end")],
    "php": [("comment", "/* ", " */"), ("comment", "# ", "\n"), ("string", '"', '"'), ("string", "'", "'"), ("comment", "// ", "\n")],
    "kotlin": [("comment", "/* /* ", " */ */"), ("string", '"', '"'), ("string", '"""\n', '"""'), ("comment", "// ", "\n")],
    "scala": [("comment", "/* /* ", " */ */"), ("string", '"', '"'), ("string", '"""\n', '"""'), ("string", 's"', '"'), ("comment", "// ", "\n")],
}
LANGUAGES = sorted(WRAPS) + ["cpp", "tsx", "typescript"]


@pytest.mark.parametrize("language", LANGUAGES)
def test_spans_of_texts_put_together(language):
    wraps = WRAPS[{"cpp": "c", "tsx": "javascript", "typescript": "javascript"}.get(language, language)]
    rng = random.Random(5)
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(1, 8)):
            text += rng.choice(["a = ", "é (", "x = { ", "\n} = ", "f(", "𝛼, "])
            kind, a, b = rng.choice(wraps)
            noise = rng.choice(NOISE)
            if kind == "regex" or b == '"' and a == "/[/":
                noise = noise.replace("[", "")
            start = len(text) + (a[0] == "\n")
            text += a + noise + b
            want.append((start, len(text) - (b[-1] == "\n"), kind))
            text += " ; "
        assert lexer.spans_of(text, language) == want, text
        code = lexer.mask(text, language)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert "no" not in code and "No" not in code


@pytest.mark.parametrize("language, text, code", [
    ("javascript", "`a ${ {x: `b ${c} }`} } d` + e", "{x: c } + e"),
    ("javascript", "a / b / c", "a / b / c"),
    ("javascript", "return /* x */ /a'b/ + y", "return + y"),
    ("javascript", "'open\nx", "x"),
    ("kotlin", '"a ${f("}")} b" + x', "f( ) + x"),
    ("c_sharp", '$"{{x}} {y}" + z', "y + z"),
    ("rust", "fn f<'a>(x: &'a str) { '{' ; b'}' }", "fn f<'a>(x: &'a str) { ; b }"),
    ("cpp", "1'000'000 + u8'{' + '\\''", "1'000'000 + u8 +"),
    ("ruby", "f(<<~A, <<-'B')\n } def\n A\n end\nB\nx", "f(<<~A, <<-'B') x"),
    ("php", "$x = <<<EOT\n }\nEOT;\n$y", "$x = <<<EOT ; $y"),
    ("ruby", '"#{a.map { |b| "}" }} c" + d', "a.map { |b| } + d"),
    ("unknown", '"a" // b', '"a" // b'),
    ("go", "", ""),
    ("java", "/* open }", ""),
    ("java", '"open \\', ""),
])
def test_masks(language, text, code):
    """What is left, blanks aside. The name of a here-document stands in code, its text doesn't."""
    got = lexer.mask(text, language)
    assert got.split() == code.split() and len(got) == len(text)


CASES = {
    "javascript": ("/** said } */\nfunction a() {\n  const s = `} ${ g({x: 1}) } {`; // }\n  function b() { return /[/}]/; }\n  return '}' /* { function no() { */;\n}\nconst c = (x) =>\n  x / 2;\nfunction d({p} = {}) { return \"}\"; }\n", [("a", 2, 6, True), ("b", 4, 4, False), ("c", 7, 8, False), ("d", 9, 9, False)]),
    "typescript": ("export class A {\n  x = '}';\n}\n// class No {\nexport async function f(\n  a: string,\n): Promise<void> {\n  a = `{`;\n}\n", [("A", 1, 3, False), ("f", 5, 9, True)]),
    "go": ("package p\n\n// F }\nfunc F(a interface{}) interface{} {\n\treturn `}\nfunc no() {\n`\n}\ntype S struct {\n\tx int // }\n}\n", [("F", 4, 8, True), ("S", 9, 11, False)]),
    "rust": ("fn a<'x>(s: &'x str) -> char {\n  let r = r#\"}\" fn no() {\"#;\n  /* /* } */ } */\n  '{'\n}\ntrait T {\n  fn b();\n  fn c() { }\n}\n", [("a", 1, 5, False), ("T", 6, 9, False), ("b", 7, 7, False), ("c", 8, 8, False)]),
    "java": ("class A {\n  // void no() {\n  public int f(int a,\n      int b) {\n    if (a > 1) {\n      return new B(a) {\n      };\n    } else if (b > 1) {\n      x(\"}\");\n    }\n    return '{';\n  }\n  public void g() { }\n}\n", [("A", 1, 14, False), ("f", 3, 12, True), ("g", 13, 13, False)]),
    "c": ("#define X {\n/* doc } */\nint f(int a,\n   char b)\n{\n  if (a) { puts(\"}\"); }\n}\nint g(void);\nstatic int h(void) {\n  return f(1, '}');\n}\n", [("f", 3, 7, True), ("h", 9, 11, False)]),
    "cpp": ("struct P {\n  int x = 1'000; // }\n};\nauto s = R\"(} struct No {)\";\nint f() {\n  return 1;\n}\n", [("P", 1, 3, False), ("f", 5, 7, False)]),
    "c_sharp": ("class A\n{\n  string s = @\"\\\";\n  // }\n  public string F(int x)\n  {\n    return $\"}} {G(\"}\")} {{\";\n  }\n}\n", [("A", 1, 9, False), ("F", 5, 8, True)]),
    "ruby": ("# x\nclass A\n  def go(x)\n    return 1 if x\n    s = <<~EOS\n      end def no\n    EOS\n    while x do\n      y \"#{z} end\"\n    end\n    [1].each do |q|\n      q\n    end\n  end\n  def two = 2\nend\n", [("A", 2, 16, True), ("go", 3, 14, False), ("two", 15, 15, False)]),
    "php": ("<?php\n# } class No {\nclass A {\n  public function f($x) {\n    return \"} {$x->y('}')} {\" . <<<T\n}\nT;\n  }\n}\n", [("A", 3, 9, True), ("f", 4, 8, False)]),
    "kotlin": ("fun a() = 1\nfun b(): String {\n  return \"\"\"} ${c { \"}\" }} fun no() {\"\"\"\n}\nclass K {\n  fun d() { /* /* } */ } */ }\n}\n", [("a", 1, 1, False), ("b", 2, 4, False), ("K", 5, 7, False), ("d", 6, 6, False)]),
    "scala": ("object O {\n  def f(x: Int) = {\n    s\"} ${g(\"}\")} {\"\n  }\n  // def no = {\n  def h = 'sym\n}\n", [("O", 1, 7, False), ("f", 2, 4, False), ("h", 6, 6, True)]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_definitions_amid_misleading_text(language):
    text, want = CASES[language]
    got = parse.symbols_of(text, language)
    assert [(s["name"], s["start_line"], s["end_line"], s["doc"]) for s in got] == want
    assert not any({"no", "No", "said"} & set(s["refs"]) for s in got)


def test_imports_in_comments_and_strings_are_none():
    js = "import a from 'a'\n// import b from 'b'\nconst s = `\nimport c from 'c'\n`\n/*\nimport {d} from 'd'\n*/\nimport {e} from 'e'\n"
    assert set(parse.imports_of(js, "typescript")) == {"a", "e", "e:e"}
    assert parse.imports_of('package p\n// import "no"\nimport "fmt"\n', "go") == ["fmt"]
    assert parse.imports_of("/*\nimport a.b;\n*/\nimport c.d;\n", "java") == ["c.d"]
    assert parse.imports_of('#include <a.h>\n/* \n#include <b.h>\n*/\n#include "c.h"\n', "c") == ["a.h", "c.h"]


def test_lexing_a_table(spark):
    rows = [("a", "java", 'x = "é";\n/* one\ntwo */ y'), ("b", "java", None), ("c", None, "// x"), ("d", "other", "// x"), ("e", "java", "")]
    got = lexer.lex(spark.createDataFrame(rows, "path string, language string, text string")).collect()
    assert [tuple(r) for r in got] == [("a", "string", 4, 7, 1, 1), ("a", "comment", 9, 22, 2, 3)]
    assert lexer.lex(spark.createDataFrame([], "path string, language string, text string")).count() == 0


def test_long_texts_take_time_in_proportion():
    text = 'f("}"); /* { */ ' * 60_000
    assert len(lexer.spans_of(text, "java")) == 120_000
    assert lexer.spans_of("`${" * 20_000, "javascript")[-1][1] == 60_000


def test_table_function_equals_the_parser(spark):
    rows = [(k, language, text) for k, (language, (text, _)) in enumerate(CASES.items())] + [(90, "python", "class A:\n    def f(self): pass\n"), (91, "java", None), (92, None, "x")]
    files = spark.createDataFrame([(str(p), lang, t) for p, lang, t in rows], "path string, language string, text string")
    parse.register_analyze(spark)
    files.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT s.* FROM some_files f, LATERAL analyze(f.path, f.language, f.text) s").collect()
    assert sorted(got) == sorted(parse.parse_symbols(files).collect()) and len(got) > 30


def test_spans_of_many_files_are_one_table(spark, monkeypatch):
    """A task hands back tables of many files' spans, and none is left behind."""
    df = spark.createDataFrame([(f"f{i}", "go", f"// {i}\nx = \"a\"\n") for i in range(50)] + [("none", "go", None)], "path string, language string, text string").coalesce(1)
    pdf = df.toPandas()
    held = {}
    monkeypatch.setattr(lexer, "SPAN_ROWS", 30)

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            held["run"] = run

    lexer.lex(Files())
    frames = list(held["run"](iter([pdf, pdf.iloc[:0], pdf])))
    assert len(frames) <= 8 and sum(map(len, frames)) == 200
    assert lexer.lex(df).count() == 100
