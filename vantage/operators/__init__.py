"""Dataflow operators over pages, cells, windows, boxes, samples and vectors."""
