"""Streaming has no counterpart in the operator inventory: there are no event times, watermarks or late data in it.

What can grow page by page needs no state beyond a page, so the readers and operators of this package also take streaming
DataFrames where they only select, filter or map (sources.text.annotations, functions.*, operators.features.hog).
"""
