"""Notices are read over whole texts."""

from graphloom.llm import handwritten
from graphloom.llm import queries as q

FILES = "file_id long, project_id string, file_path string, text string, language string, source_hash string"


def test_notices_in_footers(spark, tables):
    code = "\n".join(f"def step_{i}(node):\n    return node.enter({i})  # do not modify" for i in range(2000))
    foot = code + "\n\n# @generated by clientforge 8.21\n"
    note = lambda t, hashes=True: handwritten.notice(t, handwritten.comments(t, hashes))
    assert len(foot) > 20_000 and note(foot) == "generated" == handwritten.notice(foot) and note(code) is None
    assert note("f();\n" * 9000 + "/*\n * Regenerate with: forge\n */\n", False) == "generated"
    assert note(code + '\nT = """\n# @generated by x\n"""\n') is None and note("x\n" * 90 + "// @generated by x") == "generated"
    short = code[:2000]
    of = lambda t: handwritten.describe(t, True, handwritten.comments(t, True))
    assert of(short + "\n# @generated by x\n# and more\n")[0] == of(short + "\n")[0] and of(foot)[1] == of(code)[1]
    files = [(1, "p", "a.py", foot, "", ""), (2, "p", "b.py", code, "", "")]
    got = {r.file_id: (r.verdict, r.notice) for r in q.p4_verdicts(spark, tables(source_files=(files, FILES))).collect()}
    assert got[1] == ("generated", "generated") and got[2][0] == "vendored"
