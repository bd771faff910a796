"""Persuasion-move analytics over large tables and streams of text, on Spark."""

from swayscan.plans.scan import moves, scan
from swayscan.sources.pack import RulePack, bundled_pack, load_rule_pack

__all__ = ["RulePack", "bundled_pack", "load_rule_pack", "moves", "scan"]
