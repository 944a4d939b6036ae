from __future__ import annotations

from lociflow.genotypes import GenotypeFrame


def frame_of(spark, rows: list[str], populations: list[str] | None = None, chroms: list[str] | None = None, positions: list[int] | None = None, ref: str | None = None, alt: list[list[str]] | None = None, depth: list[list[int]] | None = None) -> GenotypeFrame:
    """A bundle from one string of codes a sample."""
    n = len(rows[0]) if rows else 0
    calls = [(j, i, None if c == "N" else c, *([depth[i][j]] if depth else [])) for i, r in enumerate(rows) for j, c in enumerate(r)]
    schema = "locus_idx long, sample_idx long, gt string" + (", depth long" if depth else "")
    loci = [(j, (chroms or ["1"] * n)[j], (positions or list(range(1, n + 1)))[j], (ref or "A" * n)[j], (alt or [["C"]] * n)[j], f"locus_{j + 1}") for j in range(n)]
    samples = [(i, f"s{i}", (populations or ["NA"] * len(rows))[i]) for i in range(len(rows))]
    return GenotypeFrame(
        spark.createDataFrame(calls, schema),
        spark.createDataFrame(loci, "locus_idx long, chrom string, pos long, ref string, alt array<string>, marker_name string"),
        spark.createDataFrame(samples, "sample_idx long, sample_id string, population string"),
    )


def matrix(frame: GenotypeFrame) -> list[str]:
    cells = {(r["sample_idx"], r["locus_idx"]): r["gt"] or "N" for r in frame.calls.collect()}
    loci = sorted(r["locus_idx"] for r in frame.loci.collect())
    return ["".join(cells[s, j] for j in loci) for s in sorted(r["sample_idx"] for r in frame.samples.collect())]


def kept(frame: GenotypeFrame) -> list[int]:
    return sorted(r["locus_idx"] for r in frame.loci.collect())
