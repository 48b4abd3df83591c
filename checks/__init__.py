"""Inputs and reference SQL for the registered queries."""
