"""Expressions that are written once and rendered for Spark SQL or for a second SQL engine.

Each function of ``glossweave.functions`` takes a dialect and SQL text for its arguments and returns SQL text.
Rendered for Spark it is a plain column expression that Catalyst optimises and compiles; rendered for
the other engine it is the oracle of the same query.
"""

from __future__ import annotations


class Dialect:
    name = ""

    def text(self, s: str) -> str:
        raise NotImplementedError

    def any_of(self, x: str, values: list[str]) -> str:
        return f"{x} IN ({', '.join(self.text(v) for v in values)})"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        raise NotImplementedError

    def strip(self, x: str) -> str:
        """Without white space at either end, in one pass from each."""
        raise NotImplementedError

    def without(self, x: str, pattern: str, members: str) -> str:
        """``x`` without the matches of a pattern, by which all characters of the class ``[members]`` go and no other."""
        raise NotImplementedError

    def without_chars(self, x: str, pattern: str, chars: str) -> str:
        """The same for a few characters."""
        raise NotImplementedError

    def runs(self, x: str, members: str, by: str) -> str:
        """The runs of characters of the class ``[members]``, joined by one that is not among them."""
        raise NotImplementedError

    def unless_empty(self, x: str, default: str) -> str:
        raise NotImplementedError

    def count(self, x: str, pattern: str) -> str:
        """How many characters of ``x`` a class holds."""
        raise NotImplementedError

    def rewrite(self, x: str, pattern: str, m: str, by: str) -> str:
        """``x`` with every match ``m`` of the pattern replaced by the expression ``by``."""
        raise NotImplementedError

    def where_found(self, x: str, needed: str, e: str, other: str) -> str:
        """``e``, which is ``other`` where ``x`` lacks a pattern; one that is quick to look for spares Spark the work on most texts."""
        raise NotImplementedError

    def lines(self, x: str) -> str:
        raise NotImplementedError


class Spark(Dialect):
    name = "spark"

    def text(self, s: str) -> str:
        escaped = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        return f"'{escaped}'"

    def strip(self, x: str) -> str:
        return f"btrim({x}, {self.text(BLANKS)})"

    def rewrite(self, x: str, pattern: str, m: str, by: str) -> str:
        between, found = f"split({x}, {self.text(pattern)})", f"transform({self.all(x, pattern)}, {m} -> {by})"
        return f"array_join(zip_with({between}, {found}, (rest, {m}) -> concat(rest, coalesce({m}, ''))), '')"

    def where_found(self, x: str, needed: str, e: str, other: str) -> str:
        return f"CASE WHEN {self.like(x, needed)} THEN {e} ELSE {other} END"

    def let(self, value: str, name: str, e: str) -> str:
        """``e`` with ``name`` for a value that is computed once."""
        return f"transform(array({value}), {name} -> {e})[0]"

    def grouped(self, x: str) -> str:
        return f"format_number(CAST({x} AS BIGINT), 0)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def numbered(self, a: str, v: str, i: str, e: str) -> str:
        """Like ``map``, with the position from 1."""
        return f"transform({a}, ({v}, {i}) -> {e})".replace(f"<{i}>", f"CAST({i} + 1 AS BIGINT)")

    def concat_lists(self, *lists: str) -> str:
        return f"concat({', '.join(lists)})"

    def where_position(self, a: str, x: str) -> str:
        return f"CAST(array_position({a}, {x}) AS BIGINT)"

    def position(self, x: str, y: str) -> str:
        return f"CAST(instr({x}, {y}) AS BIGINT)"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.text(pattern)})"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace(chr(92), '$'))})"

    def without(self, x: str, pattern: str, members: str) -> str:
        # A class is one test a character where alternatives are several, and a run goes at once.
        return self.sub(x, f"[{members}]+")

    def without_chars(self, x: str, pattern: str, chars: str) -> str:
        return self.translate(x, chars, "")

    def runs(self, x: str, members: str, by: str) -> str:
        # What lies between them is a negated class, which takes many times longer to match.
        return self.join(self.all(x, f"[{members}]+"), by)

    def unless_empty(self, x: str, default: str) -> str:
        return f"coalesce(nullif({x}, ''), {self.text(default)})"

    def count(self, x: str, pattern: str) -> str:
        # By what is left without the runs: regexp_count makes a string of each character.
        return f"CAST(length({x}) - length({self.sub(x, f'{pattern}+')}) AS BIGINT)"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def get(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def where(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})"

    def fold(self, a: str, start: str, acc: str, v: str, e: str) -> str:
        return f"aggregate({a}, {start}, ({acc}, {v}) -> {e})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        return f"get({a}, CAST({i} AS INT) - 1)"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.text(by)})"

    def lines(self, x: str) -> str:
        return f"split({x}, '\\n')"

    def head(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})"

    def sorted_set(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"endswith({x}, {y})"

    def number(self, x: str, kind: str) -> str:
        return f"try_cast({x} AS {kind})"

    def put(self, x: str, old: str, new: str) -> str:
        return f"replace({x}, {self.text(old)}, {self.text(new)})"

    def translate(self, x: str, a: str, b: str) -> str:
        return f"translate({x}, {self.text(a)}, {self.text(b)})"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, {self.text('$.' + path)})"

    def valid_json(self, x: str) -> str:
        return f"(try_parse_json({x}) IS NOT NULL)"

    def json_kind(self, x: str, path: str = "$") -> str:
        """object, array, string, int, bool, null or number; null where there is nothing."""
        kind = f"schema_of_variant(try_variant_get(try_parse_json({x}), {self.text(path)}, 'variant'))"
        return self.let(kind, "kind", "CASE WHEN startswith(kind, 'OBJECT') THEN 'object' WHEN startswith(kind, 'ARRAY') THEN 'array' WHEN kind = 'STRING' THEN 'string' WHEN kind = 'BIGINT' THEN 'int' WHEN kind = 'BOOLEAN' THEN 'bool' WHEN kind = 'VOID' THEN 'null' WHEN kind IS NOT NULL THEN 'number' END")

    def json_list(self, x: str, path: str) -> str:
        """The elements of an array, strings plain and the rest as JSON."""
        return f"coalesce(from_json(get_json_object({x}, {self.text(path)}), 'array<string>'), array())"

    def empty_list(self) -> str:
        return "CAST(array() AS ARRAY<STRING>)"

    def steps(self, n: str) -> str:
        return f"sequence(CAST(1 AS BIGINT), CAST({n} AS BIGINT))"

    def part(self, a: str, lo: str, hi: str) -> str:
        """Elements from place ``lo`` to ``hi``."""
        return f"slice({a}, CAST({lo} AS INT), CAST(greatest({hi} - {lo} + 1, 0) AS INT))"

    def substr(self, x: str, lo: str) -> str:
        return f"substring({x}, CAST({lo} AS INT))"

    def integer(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def bytes(self, x: str) -> str:
        return f"CAST(octet_length({x}) AS BIGINT)"

    def words(self, x: str) -> str:
        return self.all(x, r"[^\s]+")

    def last(self, x: str) -> str:
        return f"right({x}, 1)"

    def largest(self, a: str) -> str:
        return f"CAST(array_max({a}) AS BIGINT)"

    def padded(self, a: str, n: int) -> str:
        return f"slice(concat({a}, array_repeat('', {n})), 1, {n})"


class Oracle(Dialect):
    name = "oracle"

    def text(self, s: str) -> str:
        parts = s.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\r", "'||chr(13)||'").replace("\t", "'||chr(9)||'").replace("\0", "'||chr(0)||'")
        return f"('{parts}')" if "||" in parts else f"'{parts}'"

    def strip(self, x: str) -> str:
        return f"trim({x}, {self.text(BLANKS)})"

    def rewrite(self, x: str, pattern: str, m: str, by: str) -> str:
        between, found = f"string_split_regex({x}, {self.text(pattern)})", f"list_transform({self.all(x, pattern)}, lambda {m}: {by})"
        return f"array_to_string(list_transform(list_zip({between}, {found}), lambda z: z[1] || coalesce(z[2], '')), '')"

    def where_found(self, x: str, needed: str, e: str, other: str) -> str:
        return e

    def let(self, value: str, name: str, e: str) -> str:
        return f"list_transform([{value}], lambda {name}: {e})[1]"

    def grouped(self, x: str) -> str:
        return f"format('{{:,}}', CAST({x} AS BIGINT))"

    def distinct(self, a: str) -> str:
        return f"list_filter({a}, lambda item, place: list_position({a}, item) = place)"

    def numbered(self, a: str, v: str, i: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}, {i}: {e})".replace(f"<{i}>", i)

    def concat_lists(self, *lists: str) -> str:
        return f"({' || '.join(lists)})"

    def where_position(self, a: str, x: str) -> str:
        return f"CAST(list_position({a}, {x}) AS BIGINT)"

    def position(self, x: str, y: str) -> str:
        return f"instr({x}, {y})"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def without(self, x: str, pattern: str, members: str) -> str:
        return self.sub(x, pattern)

    def without_chars(self, x: str, pattern: str, chars: str) -> str:
        return self.sub(x, pattern)

    def runs(self, x: str, members: str, by: str) -> str:
        return self.sub(self.sub(x, f"[^{members}]+", by), f"^{by}+|{by}+$")

    def unless_empty(self, x: str, default: str) -> str:
        return f"CASE WHEN {x} = '' THEN {self.text(default)} ELSE {x} END"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.text(pattern)}))"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def get(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def where(self, a: str, v: str, e: str) -> str:
        return f"list_filter({a}, lambda {v}: {e})"

    def fold(self, a: str, start: str, acc: str, v: str, e: str) -> str:
        return f"list_reduce({a}, lambda {acc}, {v}: {e}, {start})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def join(self, a: str, by: str) -> str:
        return f"array_to_string({a}, {self.text(by)})"

    def lines(self, x: str) -> str:
        return f"string_split({x}, chr(10))"

    def head(self, a: str, n: int) -> str:
        return f"({a})[1:{n}]"

    def sorted_set(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def minus(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda gone: NOT list_contains({b}, gone))"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"ends_with({x}, {y})"

    def number(self, x: str, kind: str) -> str:
        return f"try_cast({x} AS {kind})"

    def put(self, x: str, old: str, new: str) -> str:
        return f"replace({x}, {self.text(old)}, {self.text(new)})"

    def translate(self, x: str, a: str, b: str) -> str:
        return f"translate({x}, {self.text(a)}, {self.text(b)})"

    def json(self, x: str, path: str) -> str:
        return f"CASE WHEN json_valid({x}) THEN json_extract_string({x}, {self.text('$.' + path)}) END"

    def valid_json(self, x: str) -> str:
        return f"coalesce(json_valid({x}), false)"

    def json_kind(self, x: str, path: str = "$") -> str:
        kind = f"CASE WHEN json_valid({x}) THEN json_type({x}, {self.text(path)}) END"
        return self.let(kind, "kind", "CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' END")

    def json_list(self, x: str, path: str) -> str:
        return f"CASE WHEN json_valid({x}) THEN coalesce(json_extract_string({x}, {self.text(path + '[*]')}), []) ELSE [] END"

    def empty_list(self) -> str:
        return "CAST([] AS VARCHAR[])"

    def steps(self, n: str) -> str:
        return f"range(1, {n} + 1)"

    def part(self, a: str, lo: str, hi: str) -> str:
        return f"({a})[{lo}:{hi}]"

    def substr(self, x: str, lo: str) -> str:
        return f"substr({x}, {lo})"

    def integer(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def bytes(self, x: str) -> str:
        return f"strlen({x})"

    def words(self, x: str) -> str:
        return self.all(x, r"[^\s]+")

    def last(self, x: str) -> str:
        return f"right({x}, 1)"

    def largest(self, a: str) -> str:
        return f"list_max({a})"

    def padded(self, a: str, n: int) -> str:
        return f"list_concat({a}, [{', '.join(chr(39) * 2 for _ in range(n))}])[1:{n}]"


#: White space in both engines' terms.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as characters.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
