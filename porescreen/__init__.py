"""Screening of porous crystals as Spark jobs.

``sources``    text and table scans that yield atom, voxel, path and feature tables
``functions``  column expressions: lattice algebra, names, number formats, medians
``operators``  DataFrame -> DataFrame operators
``plans``      the full screening run and the registered queries with their SQL twins
"""
