"""Spark jobs over the tables of a multi-step task pipeline.

Messages, task and job states, step results, model responses and logs are
DataFrames; every public function takes DataFrames and returns DataFrames, and
none of them starts an action.
"""
