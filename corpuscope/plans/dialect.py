"""The few spellings in which Spark SQL and DuckDB SQL differ, so that a query is written once."""

from __future__ import annotations


class Dialect:
    """Spark SQL."""

    name = "spark"

    def lit(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rx(self, value: str, pattern: str) -> str:
        return f"regexp_like({value}, {self.lit(pattern)})"

    def all(self, value: str, pattern: str) -> str:
        return f"regexp_extract_all({value}, {self.lit(pattern)}, 0)"

    def sub(self, value: str, pattern: str, by: str) -> str:
        return f"regexp_replace({value}, {self.lit(pattern)}, {self.lit(by)})"

    def split(self, value: str, pattern: str) -> str:
        return f"split({value}, {self.lit(pattern)})"

    def ends(self, value: str, suffix: str) -> str:
        return f"endswith({value}, '{suffix}')"

    def starts(self, value: str, prefix: str) -> str:
        return f"startswith({value}, {self.lit(prefix)})"

    def posexplode(self, columns: str, source: str, array: str, pos: str, item: str) -> str:
        """columns of source with each item of an array and its place from 0."""
        return f"SELECT {columns}, CAST({pos} AS BIGINT) AS {pos}, {item} FROM {source} LATERAL VIEW posexplode({array}) AS {pos}, {item}"

    def size(self, array: str) -> str:
        return f"coalesce(array_size({array}), 0)"

    def median(self, value: str) -> str:
        """The upper median: the element n / 2 (from 0) of the sorted values."""
        return f"element_at(array_sort(collect_list({value})), CAST(floor(count({value}) / 2) AS INT) + 1)"

    def join_sorted(self, value: str, order: str, sep: str = " ") -> str:
        return f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def list_sorted(self, value: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), s -> s.v)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, z) -> s + z)"

    def doubles(self, vector: str) -> str:
        return f"CAST({vector} AS ARRAY<DOUBLE>)"

    def lev(self, a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"

    def series(self, name: str, low: str, high: str) -> str:
        """A relation of whole numbers from low to high."""
        return f"SELECT explode(sequence(CAST({low} AS BIGINT), CAST({high} AS BIGINT))) AS {name}"

    real = "DOUBLE"
    #: Relation of (word, stem) that a query's own words are looked up in.
    stems = "word_stems"
    text = "STRING"
    words_a = "(?U)\\S+"


class Duck(Dialect):
    """DuckDB SQL."""

    name = "duckdb"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def rx(self, value: str, pattern: str) -> str:
        return f"regexp_matches({value}, {self.lit(pattern)})"

    def all(self, value: str, pattern: str) -> str:
        return f"regexp_extract_all({value}, {self.lit(pattern)})"

    def sub(self, value: str, pattern: str, by: str) -> str:
        return f"regexp_replace({value}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def split(self, value: str, pattern: str) -> str:
        return f"regexp_split_to_array({value}, {self.lit(pattern)})"

    def ends(self, value: str, suffix: str) -> str:
        return f"ends_with({value}, '{suffix}')"

    def starts(self, value: str, prefix: str) -> str:
        return f"starts_with({value}, {self.lit(prefix)})"

    def posexplode(self, columns: str, source: str, array: str, pos: str, item: str) -> str:
        return f"SELECT {columns}, CAST(unnest(range(len({array}))) AS BIGINT) AS {pos}, unnest({array}) AS {item} FROM {source}"

    def size(self, array: str) -> str:
        return f"coalesce(len({array}), 0)"

    def median(self, value: str) -> str:
        return f"list_extract(list_sort(list({value})), CAST(floor(count({value}) / 2) AS INT) + 1)"

    def join_sorted(self, value: str, order: str, sep: str = " ") -> str:
        return f"string_agg({value}, '{sep}' ORDER BY {order})"

    def list_sorted(self, value: str, order: str) -> str:
        return f"list({value} ORDER BY {order})"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product({a}, {b})"

    def doubles(self, vector: str) -> str:
        return f"CAST({vector} AS DOUBLE[])"

    def lev(self, a: str, b: str) -> str:
        """By characters: this engine counts bytes, so accented letters are written as capitals first."""
        low, up = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ()[]{}<"
        return f"levenshtein(translate({a}, '{low}', '{up}'), translate({b}, '{low}', '{up}'))"

    def series(self, name: str, low: str, high: str) -> str:
        return f"SELECT unnest(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1)) AS {name}"

    stems = "stem_dim"
    text = "VARCHAR"
    words_a = "[^\\s\\x{85}\\p{Z}]+"


SPARK, DUCK = Dialect(), Duck()
