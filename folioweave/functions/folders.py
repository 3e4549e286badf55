"""Folder paths and access rules.

Access is a list of folders: None is everything, an empty list is nothing. Two kinds of principals
differ in what an empty list means: for a key it is everything, for a user nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    kind: str = "user"  # or "key"
    access_all: bool = False
    allowed_folders: tuple[str, ...] = ()
    scopes: tuple[str, ...] = field(default=("read",))
    role: str = "user"

    @property
    def unrestricted(self) -> bool:
        return not self.allowed_folders if self.kind == "key" else self.access_all

    def has_scope(self, scope: str) -> bool:
        if self.kind == "key":
            return scope in self.scopes
        return self.role == "admin" or scope == "read"


def normalize_folder(path: Column | str) -> Column:
    """Trimmed, with one slash at both ends and between segments."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.concat(F.lit("/"), F.trim(F.coalesce(path, F.lit(""))), F.lit("/")), "/+", "/")


def normalize_folder_name(path: str) -> str:
    return "/" + "/".join(p for p in path.strip().split("/") if p) + ("/" if path.strip().strip("/") else "")


def is_within(path: Column, allowed: Column) -> Column:
    """Whether a folder is another or lies under it, by whole segments."""
    return F.startswith(normalize_folder(path), normalize_folder(allowed))


def key_allows(path: Column, allowed: Column) -> Column:
    return (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.coalesce(F.exists(allowed, lambda a: is_within(path, a)), F.lit(False))


def user_allows(path: Column, access_all: Column, allowed: Column) -> Column:
    return access_all | F.coalesce(F.exists(allowed, lambda a: is_within(path, a)), F.lit(False))


def ancestors(path: Column) -> Column:
    """The folder and all folders above it, from the root down: ['/', '/a/', '/a/b/']."""
    parts = F.filter(F.split(normalize_folder(path), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def restrict(df: DataFrame, principal: Principal, folder: str = "folder") -> DataFrame:
    """The rows whose folder the principal may see.

    The allowed folders become one array literal that each row's ancestors are held against: no
    join, no shuffle, and the filter stays in the scan's stage.
    """
    if principal.unrestricted:
        return df
    allowed = sorted({normalize_folder_name(a) for a in principal.allowed_folders})
    if not allowed:
        return df.where(F.lit(False))
    return df.where(F.arrays_overlap(ancestors(F.col(folder)), F.array(*[F.lit(a) for a in allowed])))


def restrict_by_table(df: DataFrame, allowed: DataFrame, folder: str = "folder") -> DataFrame:
    """The same for allowed folders in a table: an equi semi join on ancestors, in place of a prefix join."""
    folders = df.select(F.col(folder).alias("own")).distinct()
    visible = folders.select("own", F.explode(ancestors(F.col("own"))).alias("above")).join(allowed.select(normalize_folder("folder").alias("above")), "above", "left_semi").select("own").distinct()
    return df.join(visible, df[folder] == visible["own"], "left_semi")


def zip_folder(member: Column, base: Column) -> Column:
    """The folder of a ZIP member under a base folder."""
    return normalize_folder(F.concat_ws("/", base, F.regexp_replace(F.regexp_replace(member, r"\\", "/"), "[^/]*$", "")))


def transliterate(path: Column) -> Column:
    """German letters as ASCII pairs, in a path with slashes at both ends."""
    # fixed values
    pairs = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"), ("ẞ", "SS"), ("\\", "/")]
    for old, new in pairs:
        path = F.replace(path, F.lit(old), F.lit(new))
    return normalize_folder(path)


def has_scope(kind: Column, role: Column, scopes: Column, scope: str) -> Column:
    """``Principal.has_scope`` of principals in a table."""
    return F.when(kind == "key", F.coalesce(F.array_contains(scopes, scope), F.lit(False))).otherwise((role == "admin") | F.lit(scope == "read"))


def mapped_folder(files: DataFrame, mapping: DataFrame, default: str) -> DataFrame:
    """``folder`` of each file: what a confirmed map (file_name, folder) says, else a default.

    A name that the map has more than once goes to the first of its folders.
    """
    known = mapping.groupBy(F.col("file_name").alias("mapped_name")).agg(F.min("folder").alias("mapped_folder"))
    joined = files.join(known, F.col("file_name") == F.col("mapped_name"), "left")
    return joined.withColumn("folder", normalize_folder(F.coalesce(F.col("mapped_folder"), F.lit(default)))).drop("mapped_name", "mapped_folder")
