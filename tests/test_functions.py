import datetime

from pyspark.sql import functions as F

from quillstone.functions import dates, scoring, text


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def test_fill_correct(spark):
    rows = [("0.5", ["1/2"], True), ("5,-1", ["-1,5"], True), ("0,7", ["(7,0)", "7,0"], False), ("x = 5", ["5"], True), ("（1，2）", ["(1,2)"], True), ("abc", ["1"], False), ("", ["1"], False)]
    df = spark.createDataFrame(rows, "a string, b array<string>, want boolean")
    assert df.where(scoring.fill_correct(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_numbers(spark):
    rows = [("1/2", 0.5), ("5.", 5.0), (".5", 0.5), ("+5", 5.0), ("5d", None), ("Infinity", None), ("1/0", None), ("x=5/2", 2.5)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, v double").select(scoring.parse_number(F.col("s"))).collect()]
    assert got == [v for _, v in rows]


def test_multi_points(spark):
    rows = [([], 0.0), ([0], 3.0), ([0, 1], 1.0), ([1, 3, 4], 0.0), ([0, 2], 5.0), (None, 0.0)]
    options = F.array(*[F.lit(k) for k in range(5)])
    df = spark.createDataFrame(rows, "c array<int>, want double")
    got = df.select(scoring.multi_points(F.lit(5.0), F.col("c"), F.array(F.lit(0), F.lit(2)), options), "want").collect()
    assert all(a == b for a, b in got)


def test_wilson_and_grades(spark):
    low, high = scoring.wilson(F.lit(28), F.lit(36))
    a, b = one(spark, low), one(spark, high)
    assert abs(a - 0.6191) < 1e-3 and abs(b - 0.8829) < 1e-3
    low, high = scoring.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)
    assert one(spark, scoring.grade(F.lit(28 / 36))) == "13 級分"
    assert one(spark, scoring.grade(F.lit(-0.1))) is None
    assert one(spark, scoring.round2(F.lit(1.005))) == 1.0


def test_small_scoring(spark):
    assert [one(spark, scoring.backoff_ms(F.lit(k))) for k in (0, 1, 2, 9)] == [1200, 1200, 2400, 30000]
    assert one(spark, scoring.request_weight(F.lit("paper_grade"))) == 12 and one(spark, scoring.request_weight(F.lit("?"))) == 1
    assert one(spark, scoring.fraction(F.lit(6), F.lit(8))) == "3/4" and one(spark, scoring.fraction(F.lit(8), F.lit(4))) == "2"
    assert one(spark, scoring.stars(F.lit(4))) == "★★★" and one(spark, scoring.stars(F.lit(None).cast("int"))) == "☆☆☆"
    assert one(spark, scoring.strict_true(F.lit("false"))) is False and one(spark, scoring.strict_true(F.lit(" TRUE"))) is True
    assert abs(one(spark, scoring.segment_distance(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) - 1) < 1e-9
    assert one(spark, scoring.grid_cell(F.lit(1.2))) == 39
    assert one(spark, scoring.time_left(F.lit(1000), F.lit(0), F.lit(5000))) == 0
    labels = one(spark, scoring.stuck_labels(F.array(F.array(F.lit(5), F.lit(25)), F.array(F.lit(50), F.lit(10)), F.array(F.lit(90), F.lit(30))), F.lit(100000)))
    assert [(r["at"], r["kind"]) for r in labels] == [(5, "start"), (90, "end")]


def test_text(spark):
    assert one(spark, text.clean_text(F.lit("⚡ ① x²＋√2"))) == "① x²＋√2"
    assert one(spark, text.normalize_question(F.lit(" 求 3x = 6 "), True)) == "求 #x = #"
    assert one(spark, text.skeleton(F.lit("<b>8</b> 人 選 3"))) == "#人選#"
    assert one(spark, text.strip_tags(F.lit("a<br>b  c"))) == "a b c"
    assert one(spark, text.escape_html(F.lit('<a b="c">&'))) == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert one(spark, text.escape_formula(F.lit("a<b&lt;&x"))) == "a&lt;b&lt;&amp;x"
    h = 5381
    for c in "abc":
        h = (h * 33 + ord(c)) % 2**32
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    assert one(spark, text.string_hash(F.lit("abc"))) == digits
    assert one(spark, text.plain_formula(F.lit(r"\frac{1}{2}\times\sqrt{3}"))) == "1/2×√3"
    assert one(spark, text.error_kind(F.lit("移項錯"))) == "計算或符號失誤" and one(spark, text.error_kind(F.lit(None).cast("string"))) == "推理中間有缺口"
    assert one(spark, text.out_of_scope(F.lit(r"\cot x"))) and not one(spark, text.out_of_scope(F.lit("sec")))
    assert one(spark, text.split_list(F.lit(" a, b,,a "))) == ["a", "b"]
    assert one(spark, text.client_id(F.lit("u 1"), F.lit("q/2"))) == "u_1_q_2"
    assert one(spark, text.file_name(F.lit("My Source!"), F.lit(0))).startswith("01-my-source-")


def test_formula_text():
    cases = [(r"**答案**是 \(x+1$", r"答案是 \(x+1\)"), ("$x+1$", r"\(x+1\)"), ("$$x+1$$", r"\(x+1\)"), ("費用 $100", "費用 $100"), ("落單 $$", "落單 $$"), (r"費用 \$100", "費用 $100"), (r"a\\b", r"a\\b"), (r"\(AM$ 後面是說明", r"\(AM\) 後面是說明")]
    assert [text.balanced_formula(a) for a, _ in cases] == [b for _, b in cases]
    assert text.unicode_formula("vᵀ") == "v<sup>T</sup>"
    assert text.unicode_formula("AB→ 與 x₁") == r"\(\overrightarrow{AB}\) 與 x<sub>1</sub>"
    assert text.fraction_text("1/2 與 2024/01/02") == r"\(\frac{1}{2}\) 與 2024/01/02"
    assert text.matrix_text("[[1,2],[3,4]] [[1],[2,3]]") == r"\(\begin{bmatrix}1 & 2 \\ 3 & 4\end{bmatrix}\) [[1],[2,3]]"
    assert text.root_text("3√2 √(8+√2)") == r"\(3\sqrt{2}\) \(\sqrt{8+\sqrt{2}}\)"
    assert text.allowed_markup('<b onclick="x">a</b><script>y</script><q>z</q>') == "<b>a</b>z"
    assert text.allowed_markup('<svg onload="x"><path d="M0"></path><a>b</a></svg>', True) == '<svg><path d="M0"></path></svg>'
    assert text.safe_content(r"a<i>b</i>\(x<y\)") == r"a<i>b</i>\(x&lt;y\)"


def test_column_of_a_parser(spark):
    df = spark.createDataFrame([("$x$",), (None,)], "s string")
    assert [r[0] for r in df.select(text.as_column(text.balanced_formula)("s")).collect()] == [r"\(x\)", None]


def test_dates(spark):
    ts = F.lit(datetime.datetime(2026, 7, 15, 16, 1))
    assert str(one(spark, dates.local_day(ts))) == "2026-07-16"
    assert str(one(spark, dates.add_days(F.lit("2026-12-31").cast("date"), 1))) == "2027-01-01"
    assert one(spark, dates.days_until(F.lit("2027-01-22"), F.lit("2026-07-17"))) == 189
    assert one(spark, dates.days_until(F.lit("soon"), F.lit("2026-07-17"))) == 0
    assert one(spark, dates.is_due(F.lit(None).cast("date"), F.lit("2026-01-01").cast("date"))) is True
    assert one(spark, dates.display_day(F.lit("x"), F.lit(0), F.lit(1767225600000))) == "2026-01-01"
    assert one(spark, dates.clock_text(F.lit(61500))) == "01:01" and one(spark, dates.duration_text(F.lit(61500))) == "1分2秒"


def test_raised_and_lowered_signs():
    raised = {"⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ": "0123456789+-=()ni", "ᴬᴮᴰᴱᴳᴴᴵᴶᴷᴸᴹᴺᴼᴾᴿᵀᵁⱽᵂ": "ABDEGHIJKLMNOPRTUVW", "ᵃᵇᶜᵈᵉᶠᵍʰʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻ": "abcdefghjklmoprstuvwxyz"}
    for signs, plain in raised.items():
        assert text.unicode_formula("x" + signs) == f"x<sup>{plain}</sup>" and text.unicode_formula(f"\\(x{signs}\\)") == f"\\(x^{{{plain}}}\\)"
    assert text.unicode_formula("a₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎") == "a<sub>0123456789+-=()</sub>"
    assert text.unicode_formula("ªºₐ") == "ªºₐ"  # ordinals, and letters below, are text


def test_marks_and_symbols():
    for mark, command in text.MARKS.items():
        assert text.unicode_formula(f"z{mark}") == f"\\(\\{command}{{z}}\\)" and text.unicode_formula(f"\\(σ{mark}\\)") == f"\\(\\{command}{{σ}}\\)"
    assert text.unicode_formula("x̌中̄") == "x̌中̄"
    for c in "αωςΓΩΑΧϑϕϖϵϱϰϒµ≤≥≠≈≅≡≦≧≲≳≪≫≺≻∼≒≐⩽⩾±∓∈∉∋∌⊂⊃⊆⊇⊄⊅⊊⊋∩∪∅∖∧∨¬∀∃∴∵⇒⇔⟹⟺⇐⇑⇓⇕↔↕↦⟶⟵←↑↓↗↘↙↖∠∡∟⊾⊿⊥∥∦∣▱⌒∑∏∫∬∭∮∂∇∆∞∝∘⊕⊗⊙⋅⋆⋯⋮⋰⋱′″‴‵⁗½⅓¼¾⅞⅒⅟↉ℝℤℚℕℂℍℙℓℵ℘ℑℜℏⅆⅇⅈℋℒℱℬℰℳⅉ∛∜‖∎∙∗⨯∕⁄⌊⌋⌈⌉⟨⟩‰‱≔⊈⊉⋃⋂∁⊻∄⟸⊤⊢⊨∶∷⋚≮≯∐∯⨌⨁⇏⇎↛↺↻⇄∢⦜⟂▭◊⌢⏜⌀⬠⬡⟦⟧⏢⎧⎨⎩⎡⎣⎛⎝":
        assert text.unicode_formula(f"a{c}b") == f"a\\({c}\\)b", c
    for c in "→√×÷°−①✓○…·Ⅰ⚡□△+=<>|~中é":
        assert text.unicode_formula(f"a {c} b") == f"a {c} b", c
    assert text.unicode_formula("α≤β \\(α≤β\\)") == "\\(α≤β\\) \\(α≤β\\)"
    assert text.unicode_formula("v→ AB→C xyz→, ABCD→ é→") == "\\(\\overrightarrow{v}\\) AB→C \\(\\overrightarrow{xyz}\\), A\\(\\overrightarrow{BCD}\\) é→"
