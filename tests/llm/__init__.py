"""Tests of starmart.llm."""
