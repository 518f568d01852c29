"""Topic graph analytics on Spark: papers, jobs and posts joined through one topic ontology."""

from topicloom.model import Graph

__all__ = ["Graph"]
