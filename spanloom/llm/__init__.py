"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Ids of documents, pictures and conversations are whole numbers, or text of digits; rows of any
other text as an id make the job fail with Spark's own cast error rather than be left out, so
number them beforehand. A null id has a defined result in every module.
"""
