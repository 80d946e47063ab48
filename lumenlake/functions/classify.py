"""What kind of file an extension stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.constants import (
    FOLDER_IMAGES, FOLDER_OTHER, FOLDER_VIDEOS, SCAN_IMAGE, SCAN_VIDEO, TYPE_IMAGE, TYPE_VIDEO,
)


def is_media(ext: Column) -> Column:
    """Accepted by a folder scan (CLS1)."""
    return F.lower(ext).isin(SCAN_IMAGE + SCAN_VIDEO)


def is_image(ext: Column) -> Column:
    """Image in the catalogue sense: ten extensions, raw formats not among them (CLS2)."""
    return F.lower(ext).isin(TYPE_IMAGE)


def is_video(ext: Column) -> Column:
    """Video in the catalogue sense: eight extensions (CLS3)."""
    return F.lower(ext).isin(TYPE_VIDEO)


def type_folder(ext: Column) -> Column:
    """Folder of the by-type layout (CLS4)."""
    return F.when(is_image(ext), FOLDER_IMAGES).when(is_video(ext), FOLDER_VIDEOS) \
        .otherwise(FOLDER_OTHER)


def scan_category(ext: Column) -> Column:
    """Image or video by the wider scan lists, null for anything else."""
    low = F.lower(ext)
    return F.when(low.isin(SCAN_IMAGE), "image").when(low.isin(SCAN_VIDEO), "video")
