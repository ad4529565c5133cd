"""What a deployment may set: keys of the session, under `spark.storymetrics.`."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.storymetrics."


@dataclass(frozen=True)
class Settings:
    sample_every: int = 3
    batch_size: int = 50
    threshold: float = 0.65
    retries: int = 5
    page_limit: int = 100
    export_limit: int = 10_000
    salt: str = ""
    #: Uploaded pictures are scored, but not read.
    legacy_image_rule: bool = False
    #: Pictures in archives are frames as well as those of its videos.
    archive_images: bool = False
    #: Names of frames begin with the number of their video in the archive; else the last frame of a name wins.
    qualify_names: bool = True

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The values that the session sets, else the defaults; one of the wrong type is an error."""
        given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(cls)}
        return cls(**{name: _read(type(getattr(cls, name)), value) for name, value in given.items() if value is not None})


def _read(kind: type, value: str) -> int | float | bool | str:
    if kind is bool:
        if value.lower() not in ("true", "false"):
            raise ValueError(f"{value} is neither true nor false")
        return value.lower() == "true"
    return kind(value)
