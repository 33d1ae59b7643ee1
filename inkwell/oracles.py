"""DuckDB SQL for the registered queries, written from what each operator means and not from how Spark computes it."""

from __future__ import annotations

from inkwell import demo
from inkwell.functions.languages import OTHER, UNKNOWN, registry
from inkwell.operators.files import COUNTERS
from inkwell.queries import AFTER, BEFORE, event_files_sql
from inkwell.samples import SAMPLES

REG = registry()
SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in COUNTERS)
LINES = " + ".join(COUNTERS)
CODE, DOCS = "impl_code + test_code", "impl_comments + test_comments"


def _text(value: str) -> str:
    parts = [f"'{p}'" for p in value.replace("'", "''").split("\n")]
    for raw, name in (("\r", 13), ("\t", 9), ("\f", 12), ("\v", 11), ("\x1b", 27)):
        parts = [p.replace(raw, f"' || chr({name}) || '") for p in parts]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _events(where: str = "true") -> str:
    """The event files with language, family, extension and the two levels of directories."""
    known = {e: REG.languages[REG.by_extension[e]] for e in ("rs", "py", "ts", "md")}
    case = lambda field: "CASE " + " ".join(f"WHEN path LIKE '%.{e}' THEN '{field(x)}'" for e, x in known.items())
    return f"""(SELECT *, {case(lambda x: x.name)} ELSE '{UNKNOWN}' END AS language, {case(lambda x: x.family)} ELSE '{OTHER}' END AS family,
      coalesce(nullif(regexp_extract(path, '[.]([a-z]+)$', 1), ''), regexp_extract(path, '[^/]+$')) AS extension,
      split_part(path, '/', 1) AS one, regexp_replace(path, '^([^/]*/[^/]*)/.*$', '\\1') AS two, regexp_replace(path, '/[^/]*$', '') AS parent
      FROM ({event_files_sql(where)}))"""


def _by(key: str, name: str, source: str | None = None) -> str:
    return f"SELECT {key} AS {name}, {SUMS} FROM {source or _events()} GROUP BY 1"


TWO = "CASE WHEN two = path THEN parent ELSE two END"
#: The lines of a text: an empty last piece is none.
_SPLIT = lambda t: f"CASE WHEN {t} = '' THEN []::VARCHAR[] WHEN ends_with({t}, chr(10)) THEN string_split({t}, chr(10))[:-2] ELSE string_split({t}, chr(10)) END"
_BLANK = "trim(x, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) = ''"


def _counted(table: str, path: str, text: str, test: str = "false", kind: str = "code") -> str:
    """Files without delimiters: every line that is not blank is of one kind."""
    kinds = ("code", "comments", "blanks")
    values = {"blanks": "blank", kind: "n - blank"}
    out = ", ".join(f"(CASE WHEN {'' if side == 'test' else 'NOT '}test THEN {values.get(k, '0')} ELSE 0 END)::BIGINT AS {side}_{k}" for side in ("impl", "test") for k in kinds)
    return f"""(SELECT path, {out}, size FROM (SELECT path, test, len(l) AS n, len(list_filter(l, lambda x: {_BLANK})) AS blank, size
      FROM (SELECT {path} AS path, {test} AS test, {_SPLIT(text)} AS l, octet_length(encode({text})) AS size FROM {table})))"""


DOC = "coalesce(text, '')"
TXT = _counted("documents", "lang || '/' || source || '/' || doc_id || '.txt'", DOC, kind="comments")


def _samples(columns: str = "*", counts=None) -> str:
    """The synthesized files with the counts their samples are known to have; plain lines before them are code, or comments in prose."""
    rows = []
    for i, (_, path, _, known, _) in enumerate(SAMPLES):
        key = REG.from_path(path)
        six = counts(i) if counts else known
        rows.append(f"({i}, '{path.split('/')[0]}', '{path.split('/')[-1]}', '{key}', '{REG.languages[key].name}', '{REG.languages[key].family}', '{path.rsplit('.', 1)[-1]}', {str(path.startswith('tests/')).lower()}, {str(REG.languages[key].literate).lower()}, {', '.join(map(str, six))})")
    named = [f"(CASE WHEN {'test' if c.startswith('test') else 'NOT test'} AND {'prose' if c.endswith('comments') else 'NOT prose'} AND '{c}' NOT LIKE '%blanks' THEN p_size ELSE 0 END + s_{c})::BIGINT AS {c}" for c in COUNTERS]
    return f"""(SELECT {columns} FROM (SELECT folder || '/' || p_partkey || '/' || file AS path, key AS language_key, name AS language, family, extension, test AS is_test_file, prose, no, p_size, {", ".join(named)}
      FROM part JOIN (VALUES {", ".join(rows)}) s(no, folder, file, key, name, family, extension, test, prose, {", ".join("s_" + c for c in COUNTERS)}) ON p_partkey % {len(SAMPLES)} = no))"""


def _with_docs_as_code(i: int) -> tuple[int, ...]:
    return SAMPLES[i].docs_as_code or SAMPLES[i].known


def _without_blocks(i: int) -> tuple[int, ...]:
    known = SAMPLES[i].known
    return known if SAMPLES[i].path.startswith("tests/") else (*(known[k] + known[k + 3] for k in range(3)), 0, 0, 0)


def _placed(sort: str) -> str:
    key = {"code": CODE, "comments": DOCS, "blanks": "impl_blanks + test_blanks", "test": "test_code", "lines": LINES, "name": "0"}[sort]
    return f"SELECT row_number() OVER (ORDER BY abs({key}) DESC, path)::BIGINT AS place, path AS label, 1::BIGINT AS files, {', '.join(COUNTERS)} FROM {_events()}"


def _case(column: str, values: dict[int, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


def _names(table: str, key: str, names: tuple[str, ...], facts: dict[str, tuple], columns: tuple[str, ...], prefix: str) -> str:
    sql = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v + "'"
    rows = ", ".join(f"({i}, '{n}', {', '.join(map(sql, facts[n]))})" for i, n in enumerate(names))
    return f"SELECT '{prefix}' || {key} || '/' || name AS path, {', '.join(columns)} FROM {table} JOIN (VALUES {rows}) v(i, name, {', '.join(columns)}) ON {key} % {len(names)} = i"


PATH_FACTS = {
    "a.RS": ("Rust", "Rust", "Systems", "rs", False), "b.py": ("Python", "Python", "Scripting", "py", False), "Makefile": ("Makefile", "Makefile", "Build", "Makefile", False),
    "x.blade.php": ("Blade", "Blade", "Web", "php", False), "y.php": ("Php", "PHP", "Scripting", "php", False), "dockerfile": ("Dockerfile", "Dockerfile", "Build", "dockerfile", False),
    ".bashrc": (None, None, "Other", ".bashrc", False), "c.tar.GZ": (None, None, "Other", "gz", False), "noext": (None, None, "Other", "noext", False), "d.Tsx": ("Tsx", "TSX", "JavaScript", "tsx", False),
    "CMakeLists.txt": ("CMake", "CMake", "Build", "txt", False), "e.": (None, None, "Other", "", False),
}
TEST_FACTS = {n: (v,) for n, v in {"src/a.rs": False, "tests/a.rs": True, "x/test_a.py": True, "a_test.go": True, "x/a.test.ts": True, "spec/a": True, "src/Test.java": True, "benches/a.rs": True, "a.snap": True, "src/a_test.py.txt": False, "fixtures/x.md": True}.items()}
SHEBANGS = [("Bash", "Shell"), ("Ruby", "Scripting"), ("Python", "Scripting"), ("Perl", "Scripting")]


def _json_row() -> str:
    side = lambda s: f"'{s}': {{{', '.join(f"'{k}': {s}_{k}" for k in ('code', 'comments', 'blanks'))}}}"
    return f"SELECT to_json({{'label': extension, 'files': files, {side('impl')}, {side('test')}, 'lines': {LINES}}})::VARCHAR AS object FROM (SELECT extension, count(*)::BIGINT AS files, {SUMS} FROM {_events()} GROUP BY 1)"


def _diff(key: str, name: str, files: bool = True) -> str:
    columns = (["files"] if files else []) + list(COUNTERS)
    sums = ", ".join(f"sum(sign * {c})::BIGINT AS {c}" for c in columns)
    side = lambda sign, where: f"SELECT {sign} AS sign, 1 AS files, {key} AS k, {', '.join(COUNTERS)} FROM {_events(where)}"
    return f"SELECT k AS {name}, {sums} FROM ({side(1, AFTER)} UNION ALL {side(-1, BEFORE)}) GROUP BY 1 HAVING {' OR '.join(f'sum(sign * {c}) <> 0' for c in columns)}"


def _ratios() -> str:
    code = f"sum({CODE})"
    return f"""SELECT language, CASE WHEN {code} <> 0 THEN sum(test_code) / {code}::DOUBLE END AS test_ratio, CASE WHEN sum({LINES}) > 0 THEN 100.0::DOUBLE * sum({DOCS}) / sum({LINES}) END AS doc_share,
      coalesce(round_even(CASE WHEN {code} > 0 THEN 100.0::DOUBLE * sum(test_code) / {code} END, 0)::BIGINT || '%', '—') AS test_percent FROM {_events()} GROUP BY 1"""


def _roll_up() -> str:
    key = f"abs({CODE})"
    return f"""WITH r AS (SELECT family, language AS label, count(*)::BIGINT AS files, {SUMS} FROM {_events()} GROUP BY 1, 2),
      h AS (SELECT family, family AS label, sum(files)::BIGINT AS files, {SUMS} FROM r GROUP BY 1),
      g AS (SELECT *, row_number() OVER (ORDER BY {key} DESC, label) AS head, 0 AS member FROM h),
      m AS (SELECT r.*, head, row_number() OVER (PARTITION BY r.family ORDER BY abs(r.impl_code + r.test_code) DESC, r.label) AS member, count(*) OVER (PARTITION BY r.family) AS n FROM r JOIN g USING (family))
      SELECT row_number() OVER (ORDER BY head, member)::BIGINT AS position, kind, family, label, files, {', '.join(COUNTERS)}
      FROM (SELECT 'family' AS kind, family, label, files, {', '.join(COUNTERS)}, head, member FROM g
        UNION ALL SELECT CASE WHEN member = n THEN 'last' ELSE 'member' END, family, label, files, {', '.join(COUNTERS)}, head, member FROM m)"""


ROWS = f"(SELECT family, language AS label, count(*)::BIGINT AS files, {SUMS} FROM {_events()} GROUP BY 1, 2)"
CHANGED = "regexp_replace(coalesce(text, ''), 'the', 'THE' || chr(10), 'g')"
QUOTED = "CASE WHEN regexp_matches(label, '[,\"\\n]') THEN '\"' || replace(label, '\"', '\"\"') || '\"' ELSE label END"


def _html() -> str:
    """HTML as a fold over its delimiters: (n)either, (c)omment, (d)ouble or (s)ingle quotes. Its text is the state now, then that at each line's end."""
    state = lambda i: f"substr('n' || substr(fold, 2) || left(fold, 1), {i}, 1)"
    opened = "CASE b WHEN '\"' THEN 'd' WHEN '''' THEN 's' WHEN '<!--' THEN 'c' ELSE 'n' END"
    closed = "(left(a, 1) = 'c' AND b = '-->') OR (left(a, 1) = 'd' AND b = '\"') OR (left(a, 1) = 's' AND b = '''')"
    tokens = r"\\\\|\\[" + "\"''" + r"]|<!--|-->|" + "\"|''|" + r"\n"
    sums = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS impl_{c}, 0::BIGINT AS test_{c}" for k, c in (("code", "code"), ("comment", "comments"), ("blank", "blanks")))
    return f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (
  SELECT page_id, {_SPLIT("h")} AS l, list_reduce(list_prepend('n', regexp_extract_all(h, '{tokens}')), lambda a, b:
    CASE WHEN b = chr(10) THEN a || left(a, 1) WHEN left(a, 1) = 'n' THEN {opened} || substr(a, 2) WHEN {closed} THEN 'n' || substr(a, 2) ELSE a END) AS fold FROM t),
k AS (SELECT page_id, fold, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM f),
c AS (SELECT trim(x, ' ' || chr(9) || chr(12) || chr(13)) AS x, {state("i")} AS before, {state("i + 1")} AS after FROM k),
v AS (
  SELECT CASE WHEN before = 'n' AND x = '' THEN 'blank' WHEN after IN ('d', 's') THEN 'code'
    WHEN before = 'c' OR (starts_with(x, '<!--') AND (after = 'c' OR (ends_with(x, '-->') AND length(x) > 6))) THEN 'comment' ELSE 'code' END AS kind FROM c)
SELECT 'Web' AS family, 'HTML' AS label, (SELECT count(*) FROM pages)::BIGINT AS files, {sums} FROM v"""


def _values(columns: str, rows) -> str:
    """A table of literals: column names with types, parted by commas."""
    named = [c.split() for c in columns.split(",")]
    sql = lambda v, t: f"{'NULL' if v is None else _text(v) if isinstance(v, str) else str(v).lower()}::{t}"
    listed = ", ".join("(" + ", ".join(sql(v, t) for v, (_, t) in zip(r, named, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) v({', '.join(n for n, _ in named)})"


def _size(*found: str) -> list[tuple[str, int]]:
    texts = {p: t for p, t in (demo.FIRST | demo.SECOND | demo.LOOSE).items() if t is not None}
    return [(p, len(texts[p].encode())) for p in found]


def _trees() -> dict[str, str]:
    """What the queries over the small repository give, set by hand from its contents."""
    held = ("conf/deploy.yaml", "src/driver.c", "src/orders.py", "src/widget.ts")
    six = ", ".join(f"{c} BIGINT" for c in COUNTERS)
    lines = lambda text: _values("line_no BIGINT, line VARCHAR", enumerate(text.strip("\n").split("\n")))
    dim, bold = (lambda t: f"\x1b[2m{t}\x1b[0m"), (lambda t: f"\x1b[1m{t}\x1b[0m")
    return {
        "tree_files": _values("path VARCHAR, size BIGINT", _size(*held, "kept.tmp", "run")),
        "tree_files_unignored": _values("path VARCHAR", [(p,) for p in (*held, ".gitignore", ".ignore", *demo.LOOSE)]),
        "tree_report": _values(f"family VARCHAR, label VARCHAR, files BIGINT, {six}", [
            ("Scripting", "Python", 1, 4, 6, 2, 5, 1, 1), ("Configuration", "YAML", 1, 4, 2, 2, 0, 0, 0), ("JavaScript", "TypeScript", 1, 4, 1, 1, 5, 1, 1), ("Shell", "Shell", 1, 1, 1, 0, 0, 0, 0), ("Systems", "C", 1, 4, 7, 1, 0, 0, 0)]),
        "tree_below": _values("path VARCHAR", [("deploy.yaml",)]),
        "revision_files": _values("path VARCHAR, size BIGINT, same_id BOOLEAN", [(*f, True) for f in _size(*held)]),
        "revision_subdirectory": _values("path VARCHAR", [("driver.c",), ("orders.py",)]),
        "merge_base_change": _values(f"label VARCHAR, files BIGINT, {six}", [("src/driver.c", 0, 0, 1, 0, 0, 0, 0), ("src/widget.ts", 1, 4, 1, 1, 5, 1, 1), ("docs/guide.md", -1, 0, -4, -2, 0, 0, 0)]),
        "nothing_to_count": _values(six, [(0,) * 6]),
        "unreadable_files": "SELECT p_partkey || '.yaml' AS path, CASE WHEN p_size % 5 = 0 THEN 'denied' ELSE 'counted' END AS message FROM part",
        "refs_parsed": _values("ref VARCHAR, kind VARCHAR, spelled VARCHAR", [
            ("src", "path", "src"), ("git:HEAD~1", "git", "git:HEAD~1"), ("git:a:b", "git", "git:a:b"), ("git-merge:main:topic", "merge", "git-merge:main:topic"), ("git-merge:a:b:c", "merge", "git-merge:a:b:c"),
            ("git:", "error", None), ("git-merge:a", "error", None), ("git-merge::b", "error", None), ("", "error", None)]),
        "default_sources": _values("fact VARCHAR, value VARCHAR", [("default", "main"), ("head", "topic"), ("dirty", "True"), ("on main", "False"), ("refs", "git-merge:main:HEAD tree"), ("note", None)]),
        "subdirectories_tidied": _values("given VARCHAR, tidy VARCHAR", [(".", ""), ("./", ""), ("./src/", "src"), ("/src//", "src"), ("a\\b", "a/b"), (" src ", "src")]),
        "command_table": lines(f"""
inkwell  main
{"─" * 57}
LANGUAGE       FILES  IMPL  DOC  TEST  TOTAL  DOC%  TEST%
{"─" * 57}
Scripting          1     4    7     5     19   37%    56%
└─  Python         1     4    7     5     19   37%    56%
Configuration      1     4    2     0      8   25%     0%
└─  YAML           1     4    2     0      8   25%     0%
Systems            1     4    6     0     11   55%     0%
└─  C              1     4    6     0     11   55%     0%
Documentation      1     0    4     0      6   67%      —
└─  Markdown       1     0    4     0      6   67%      —
{"─" * 57}
TOTAL              4    12   19     5     44   43%    29%
{"─" * 57}"""),
        "command_change": lines(f"""
inkwell  main → topic  (net change)
{"─" * 57}
FILE           FILES  IMPL  DOC  TEST  TOTAL  DOC%  TEST%
{"─" * 57}
src/widget.ts     +1    +4   +2    +5    +13   15%    56%
docs/guide.md     -1     0   -4     0     -6     —      —
src/driver.c       0     0   +1     0     +1  100%      —
{"─" * 57}
TOTAL              0    +4   -1    +5     +8     —    56%
{"─" * 57}"""),
        "command_subdirectory": lines("""
family,language,files,impl_code,impl_comments,impl_blanks,test_code,test_comments,test_blanks,total
Documentation,Markdown,-1,0,-4,-2,0,0,0,-6
,TOTAL,-1,0,-4,-2,0,0,0,-6"""),
        "command_colored": lines("\n".join([
            bold("inkwell  main"), dim("─" * 53), "  ".join(map(dim, ("EXTENSION", "FILES", "IMPL", "DOC", "TEST", "TOTAL", "DOC%", "TEST%"))), dim("─" * 53),
            "py             1     4    7     5     19   37%    56%", "c              1     4    6     0     11   55%     0%", dim("─" * 53),
            f"{bold('TOTAL')}      {'  '.join(map(bold, ('    2', '   8', ' 13', '   5', '   30', ' 43%', '  38%')))}", dim("─" * 53)])),
        "registry_overlaid": _values("key VARCHAR, name VARCHAR, extensions VARCHAR, family VARCHAR, detects_tests BOOLEAN, resolved VARCHAR", [
            ("Rust", "Rust", "rs,rsx", "Systems", True, "Systems"), ("C", "C", "c,ec,pgc", "Systems", True, "Systems"), ("Toy", "Toy", "toy", "Other", True, None), ("Json", "Json", "json", "Other", False, None)]),
    }


def oracle_sql() -> dict[str, str]:
    events = _events()
    plain = _counted("documents", "lang || '/' || source || '/' || doc_id", DOC)
    turns = _counted("conversations", "CASE WHEN role = 'user' THEN 'tests' ELSE 'src' END || '/' || conv_id || '_' || turn || '.txt'", "coalesce(text, '')", "coalesce(role = 'user', false)", "comments")
    vcs, hid = "regexp_matches(path, '(^|/)[.](git|hg|svn|jj)(/|$)')", "regexp_matches(path, '(^|/)[.]([^./]|[.][^/])')"
    folders = (".git", "a/.hg/b", ".hid", "a.b", ".gitx", "x/..")
    bang = ", ".join(f"({i}, '{k}', '{f}')" for i, (k, f) in enumerate(SHEBANGS))
    total = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("files", *COUNTERS))
    families = ", ".join(f"('{f}', '{', '.join(sorted(REG.languages[k].name for k in keys)).replace(chr(39), chr(39) * 2)}')" for f, keys in REG.families.items())
    return {
        "lines_of_documents": f"SELECT path, NULL::VARCHAR AS language, '{OTHER}' AS family, regexp_extract(path, '[^/]+$') AS extension, {', '.join(COUNTERS)} FROM {plain}",
        "prose_by_source": f"SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS directory, {SUMS} FROM {TXT} GROUP BY 1",
        "turns_by_directory": f"SELECT NULL::VARCHAR AS family, split_part(path, '/', 1) AS label, count(*)::BIGINT AS files, {SUMS} FROM {turns} GROUP BY 2",
        "classify_sources": f"SELECT path, language_key, is_test_file, {', '.join(COUNTERS)} FROM {_samples()}",
        "sources_by_language": f"SELECT family, language AS label, count(*)::BIGINT AS files, {SUMS} FROM {_samples()} GROUP BY 1, 2",
        "sources_without_test_blocks": f"SELECT {SUMS} FROM {_samples(counts=_without_blocks)}",
        "docs_as_code": _by("extension", "extension", _samples(counts=_with_docs_as_code)),
        "line_kinds": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {str(t).lower()} AS is_test, sum({'test' if t else 'impl'}_{c})::BIGINT AS n FROM {_samples()}" for t in (False, True) for k, c in (("code", "code"), ("comment", "comments"), ("blank", "blanks"))) + ")",
        "binary_files": f"SELECT p_partkey || '.yaml' AS path, (1 + (p_size % 3 = 1)::INT)::BIGINT AS impl_code, {', '.join(f'0::BIGINT AS {c}' for c in COUNTERS[1:])} FROM part WHERE p_size % 3 <> 0",
        "include_exclude": f"SELECT path FROM {events} WHERE (regexp_matches(path, '(^|/)src[0-3](/|$)') OR path LIKE '%.md') AND path NOT LIKE '%/lib/%' AND NOT regexp_matches(path, '(^|/)f.[.]py$')",
        "hidden_and_vcs": f"SELECT path, NOT {vcs} AND NOT {hid} AS shown, NOT {vcs} AS shown_hidden FROM (SELECT {_case('s_suppkey % 6', {i: chr(39) + f + chr(39) for i, f in enumerate(folders)})} || '/f' || s_suppkey AS path FROM supplier)",
        "max_file_size": f"SELECT {SUMS} FROM {TXT} WHERE size <= 2000",
        "only_languages": f"SELECT language, count(*)::BIGINT AS n FROM {_samples()} WHERE language_key IN ('Rust', 'Python') GROUP BY 1",
        "ignored_files": f"""SELECT path FROM (SELECT path FROM {events} UNION ALL SELECT '.ignore' UNION ALL SELECT 'src3/.ignore') WHERE
          CASE WHEN starts_with(path, 'src3/') AND path LIKE '%.md' THEN true WHEN starts_with(path, 'src3/') AND path LIKE '%.ts' THEN false
          ELSE NOT (path LIKE '%.md' OR starts_with(path, 'src1/') OR starts_with(path, 'src2/lib/')) END""",
        "only_changed_paths": f"SELECT {SUMS} FROM {_counted('documents', 'lang', CHANGED, kind='comments')} JOIN (SELECT 1) ON true WHERE true".replace("FROM documents)", f"FROM documents WHERE {CHANGED} <> {DOC})"),
        "language_of_path": _names("part", "p_partkey", tuple(PATH_FACTS), PATH_FACTS, ("language_key", "language", "family", "extension", "is_test_file"), "d"),
        "language_of_shebang": f"SELECT 'bin/' || s_suppkey AS path, k AS language_key, coalesce(f, '{OTHER}') AS family FROM supplier LEFT JOIN (VALUES {bang}) v(i, k, f) ON s_suppkey % 8 = i",
        "test_paths": _names("supplier", "s_suppkey", tuple(TEST_FACTS), TEST_FACTS, ("is_test_file",), "r"),
        "languages_and_families": f"SELECT * FROM (VALUES {families}) v(family, members)",
        "totals": f"SELECT {SUMS} FROM {events}",
        "by_language": _by("language", "language"),
        "by_family": _by("family", "family"),
        "by_extension": _by("extension", "extension"),
        "by_path": _by("path", "path"),
        "by_directory_0": _by("'.'", "directory"),
        "by_directory_1": _by("one", "directory"),
        "by_directory_2": _by(TWO, "directory"),
        "by_any_key": _by("length(path)::BIGINT", "path_length"),
        "rows_with_files": f"SELECT * FROM {ROWS}",
        "family_roll_up": _roll_up(),
        "ratios": _ratios(),
        "merged_reports": f"SELECT {SUMS} FROM (SELECT * FROM {_events(BEFORE)} UNION ALL SELECT * FROM {_events(AFTER)})",
        **{f"sort_{s}": _placed(s) for s in ("code", "comments", "blanks", "test", "lines", "name")},
        "top_then_total": f"WITH r AS (SELECT {TWO} AS label, count(*)::BIGINT AS files, {SUMS} FROM {events} GROUP BY 1 ORDER BY sum({LINES}) DESC, 1 LIMIT 5) SELECT * FROM r UNION ALL SELECT 'TOTAL', {total} FROM r",
        "largest_files": f"SELECT path, ({LINES})::BIGINT AS lines FROM {events} ORDER BY 2 DESC, 1 LIMIT 10",
        "changed_paths": f"""WITH b AS ({event_files_sql(BEFORE)}), a AS ({event_files_sql(AFTER)})
          SELECT coalesce(a.path, b.path) AS path FROM a FULL JOIN b ON a.path = b.path WHERE coalesce(a.path, b.path) LIKE '%.md' OR a.path IS NULL OR b.path IS NULL OR {' OR '.join(f'a.{c} <> b.{c}' for c in COUNTERS)}""",
        "diff_by_language": _diff("language", "language", files=False),
        "diff_rows": _diff(TWO, "label"),
        "diff_with_itself": f"SELECT path AS label, 0::BIGINT AS files, {', '.join(COUNTERS)} FROM {events} WHERE false",
        "diff_against_nothing": f"SELECT family AS label, -count(*)::BIGINT AS files, {', '.join(f'-sum({c})::BIGINT AS {c}' for c in COUNTERS)} FROM {events} GROUP BY 1",
        "csv_rows": f"SELECT concat_ws(',', family, {QUOTED}, files, {', '.join(COUNTERS)}, {LINES}) AS line FROM {ROWS}",
        "json_rows": _json_row(),
        "pages_as_html": _html(),
        **_trees(),
    }
