"""Layered analytics over campaign-style fact tables, as plain Spark jobs."""

from adlake.spec import DEFAULT_SPEC, RAW_SCHEMA, CampaignSpec

__all__ = ["DEFAULT_SPEC", "RAW_SCHEMA", "CampaignSpec"]
