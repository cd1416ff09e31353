"""Declared schemas of the tables."""


def mapping(index: str) -> str:
    return f"path STRING, type STRING, `{index}` DOUBLE"


LEVELS = "path STRING, level INT, mpp_x DOUBLE, mpp_y DOUBLE, extent_x INT, extent_y INT"
MASK_ROWS = "mask_path STRING, y INT, mpp_x DOUBLE, mpp_y DOUBLE, row ARRAY<SMALLINT>"
EMBEDDINGS = "slide_name STRING, x INT, y INT, embedding ARRAY<FLOAT>"
TILE_COLUMNS = ("tile_x", "tile_y", "slide_id", "type", "risk_index", "tissue_overlap", "blur_overlap", "folding_overlap", "residual_overlap", "epithelium_overlap")
