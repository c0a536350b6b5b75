"""Where documents lie: choices among paths, and paths as documents name them. All go through the file system that holds the path."""
from __future__ import annotations

import posixpath
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_there(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that is there (a patched document before a raw one); the last if none is, so that reading it names it."""
    return next((p for p in paths[:-1] if there(spark, p)), paths[-1])


def beside(document: str, path: str) -> str:
    """A path that a document names: as it is if it is absolute, else from the document's folder."""
    if urlsplit(path).scheme or path.startswith("/"):
        return path
    head, tail = (f"{u.scheme}://{u.netloc}", u.path) if (u := urlsplit(document)).scheme else ("", document)
    return head + posixpath.normpath(posixpath.join(posixpath.dirname(tail), path))


def shown(path: str, root: str) -> str:
    """A path as it is shown: from the root on if it is inside, else whole."""
    inside = posixpath.normpath(path).startswith(posixpath.normpath(root).rstrip("/") + "/")
    return posixpath.relpath(path, root) if inside else path
