"""Parameters and schemas."""

from __future__ import annotations

from dataclasses import dataclass

BOX = "x1 int, x2 int, y1 int, y2 int"
QUERIES = f"query_id long, path string, {BOX}, text string, h int, w int, class_id int"
WORDS = f"word_id long, doc_id int, {BOX}, text string, h int, w int, class_id int"
PAGES = "doc_id int, path string, h int, w int, pixels binary"
CELLS = "doc_id int, r int, c int, feat array<float>"
MODELS = "query_id long, new_h int, new_w int, bh int, bw int, root array<float>"
DETECTIONS = f"query_id long, doc_id int, rank int, score double, is_relevant int, {BOX}"
VECTORS = "idx long, v array<float>"


@dataclass(frozen=True)
class Params:
    """Defaults of a retrieval run."""

    sbin: int = 12
    step: int = 1
    n_codes: int = 256
    pca_dim: int = 16
    pca_cells: int = 20_000
    shifts: tuple[int, ...] = tuple(range(-10, 11, 2))
    negatives_per_positive: int = 64
    windows_per_page: int = 2001
    nms_overlap: float = 0.2
    hit_overlap: float = 0.5
    lambda_: float = 1e-5
    eta0: float = 1e-3
    epochs: int = 10
    bias_term: float = 1.0
    result_images: int = 50

    @property
    def positives(self) -> int:
        return len(self.shifts) ** 2

    def negatives(self, pages: int) -> int:
        """Rounded up to a multiple of the pages."""
        wanted = self.positives * self.negatives_per_positive
        return -(-wanted // pages) * pages


#: Grid of the parameter search.
GRID = {"lambda_": (1e-5, 1e-3, 1e-1), "eta0": (1e-5, 1e-3, 1e-1), "bias_term": (0.5**0.5, 1.0, 2**0.5)}
