"""BM25 scoring as Spark column expressions.

Fixed values: k1 = 1.2, b = 0.75 (the defaults of the reference's library).
idf  = ln(1 + (N - df + 0.5) / (df + 0.5)), N = documents having the field
term = idf * tf / (tf + k1 * (1 - b + b * dl / avgdl))
Lengths are exact token counts (the library keeps a lossy one-byte norm).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - doc_freq + F.lit(0.5)) / (doc_freq + F.lit(0.5)))


def term_score(idf_col: Column, tf: Column, dl: Column, avgdl: Column,
               k1: float = K1, b: float = B) -> Column:
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl)
    return idf_col * tf / (tf + norm)
