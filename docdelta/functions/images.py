"""C20: page images made smaller before a model sees them."""

from __future__ import annotations

import base64
import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, QUALITY = 1280, 75


def smaller(text: str | None) -> str | None:
    """The image as JPEG of limited width; whatever cannot be read stays as it is."""
    try:
        from PIL import Image

        body = text.split(",", 1)[1] if text.startswith("data:") else text
        image = Image.open(io.BytesIO(base64.b64decode(body))).convert("RGB")
        if image.width > WIDTH:
            image = image.resize((WIDTH, max(1, round(image.height * WIDTH / image.width))), Image.Resampling.LANCZOS)
        out = io.BytesIO()
        image.save(out, "JPEG", quality=QUALITY)
        return base64.b64encode(out.getvalue()).decode()
    except Exception:  # any failure means: send the original
        return text


def downscaled(images: Column) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(smaller)

    return apply(images)
