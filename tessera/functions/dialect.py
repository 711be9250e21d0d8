"""One way to write an expression for Spark SQL and, for the checks, for DuckDB."""

from __future__ import annotations


class Spark:
    """Spark SQL spellings; every method returns the text of an expression."""

    name = "spark"

    def pattern(self, p: str) -> str:
        return "r'" + p.replace("'", r"\x27") + "'"

    def match(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pattern(p)})"

    def extract(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, 0)"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}')"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)})"

    def item(self, a: str, i: str) -> str:
        return f"try_element_at({a}, CAST({i} AS INT))"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def transform(self, a: str, var: str, body: str) -> str:
        return f"transform({a}, {var} -> {body})"

    def filter(self, a: str, var: str, body: str) -> str:
        return f"filter({a}, {var} -> {body})"

    def upto(self, n: str) -> str:
        """0 .. n - 1"""
        return f"filter(sequence(0, CAST({n} AS INT)), __i -> __i < {n})"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST({n} AS INT))"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, '{by}')"

    def distinct(self, a: str) -> str:
        """Number of different items."""
        return f"CAST(size(array_distinct({a})) AS BIGINT)"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def mod(self, a: str, b: str) -> str:
        return f"pmod({a}, {b})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def unnest(self, a: str, keep: str, source: str, pos: str = "pos", item: str = "item") -> str:
        return f"SELECT {keep}, CAST({pos} AS BIGINT) AS {pos}, {item} FROM {source} LATERAL VIEW posexplode({a}) AS {pos}, {item}"

    def unnest_both(self, a: str, b: str, keep: str, source: str, pos: str, x: str, y: str) -> str:
        """Two array columns side by side, a row for each item of the longer one, nulls beside the rest."""
        return f"SELECT {keep}, CAST({pos} AS BIGINT) AS {pos}, both_.{a} AS {x}, both_.{b} AS {y} FROM {source} LATERAL VIEW posexplode(arrays_zip({a}, {b})) AS {pos}, both_"

    def listagg(self, x: str, by: str, order: str) -> str:
        """The texts of a group in order; collected as pairs, so that order doesn't rest on the shuffle."""
        return f"array_join(transform(array_sort(collect_list(struct({order} AS k, {x} AS v))), s -> s.v), '{by}')"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"

    def least_by(self, x: str, key: str) -> str:
        return f"min_by({x}, {key})"

    def greatest_by(self, x: str, key: str) -> str:
        return f"max_by({x}, {key})"

    def chars(self, x: str, start: str, n: str) -> str:
        return f"substring({x}, CAST({start} AS INT), CAST({n} AS INT))"


class Duck(Spark):
    name = "duckdb"

    def pattern(self, p: str) -> str:
        return "'" + p.replace("'", r"\x27") + "'"

    def match(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)})"

    def replace(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}', 'g')"

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.pattern(p)})"

    def item(self, a: str, i: str) -> str:
        return f"list_extract({a}, {i})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def transform(self, a: str, var: str, body: str) -> str:
        return f"list_transform({a}, lambda {var}: {body})"

    def filter(self, a: str, var: str, body: str) -> str:
        return f"list_filter({a}, lambda {var}: {body})"

    def upto(self, n: str) -> str:
        return f"range(0, {n})"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"list_slice({a}, {start}, {start} + {n} - 1)"

    def join(self, a: str, by: str) -> str:
        return f"array_to_string({a}, '{by}')"

    def distinct(self, a: str) -> str:
        return f"CAST(len(list_distinct({a})) AS BIGINT)"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def contains(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def mod(self, a: str, b: str) -> str:
        return f"((({a}) % {b} + {b}) % {b})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def unnest(self, a: str, keep: str, source: str, pos: str = "pos", item: str = "item") -> str:
        return f"SELECT {keep}, CAST(unnest(range(0, len({a}))) AS BIGINT) AS {pos}, unnest({a}) AS {item} FROM {source}"

    def unnest_both(self, a: str, b: str, keep: str, source: str, pos: str, x: str, y: str) -> str:
        return f"SELECT {keep}, CAST(unnest(range(0, greatest(len({a}), len({b})))) AS BIGINT) AS {pos}, unnest({a}) AS {x}, unnest({b}) AS {y} FROM {source}"

    def listagg(self, x: str, by: str, order: str) -> str:
        return f"string_agg({x}, '{by}' ORDER BY {order})"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

    def least_by(self, x: str, key: str) -> str:
        return f"arg_min({x}, {key})"

    def greatest_by(self, x: str, key: str) -> str:
        return f"arg_max({x}, {key})"

    def chars(self, x: str, start: str, n: str) -> str:
        return f"substr({x}, {start}, {n})"
