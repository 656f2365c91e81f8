"""Fixed rows for cases that the test tables lack."""

EDGE_ROWS = [
    "a\r\nb\rc", "certifi-\ncate", "cer‐\ntificate", "é-\nè", "a-\nb-\nc", "x\n\n\n\ny", "tab\t\tz  q", "3D", "a1b2c3d4", "abc1234def",
    "utf8mb4 10th", "U.S.A. ok", "e.g.X", "\x07bell\x85nel\x9f", "   \t ", "", " pad　", "12ab\n34cd", "9ıx", "x٣y", "١٢x", None,
    "one\n\ntwo\nthree", "end.Next!Then?Last", "page 12\n\n13Über",
]
VALIDATION_ROWS = [
    ("x", ""), ("x", "short"), ("y" * 1000, "z" * 50), ("x", "w" * 50 + "�"), ("x", "  HERE IS the translation you have been asking for"),
    ("x", "Tərcümə: something that is long enough to pass the check"), ("", "q" * 40), ("x", None), ("x", "😀" * 20), ("x", "😀" * 19),
]
ERRORS = ["OpenAI API error 429: INSUFFICIENT_QUOTA", "OpenAI API error 400: x", "status 4000 given", "timeout", "insufficient_quota 400", None, "error400"]
SIZES = ["A4", " a5 ", "letter", "Legal", "B7", "", None, "a3"]
TAGGED = [
    "<H1>PART I\n\n<P>para one\n<P>para two</P> tail dropped\nloose line",
    "<P>\nline a\n\nline b\n</H1>\nline c\n</P>\nafter",
    "- <P>item\n* <H2>bul head\n- <P></P>\n<P></P>\n• <p>\nlost bullet",
    "</P></P>\nx <P>y\n<H1>foo</P>\n<P>foo <H1>bar",
    "<H2>\na\n<H1>\nb <P>z</P>\n</h1>\nc\n</P>",
    "<h2>Intro ..... 12\n<H2>" + "long " * 25,
    "<H1>Deep .... 3",
    "<H1>- not head",
    "",
]
