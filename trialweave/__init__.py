"""A Spark-native engine for simulation campaigns: sample a parameter space, evaluate every point, keep the table.

``operators``  samplers, runners, expansion, surrogates
``functions``  column expressions: random draws, scaling, Sobol points, test functions, text
``sources``    scans, sinks and the committed store
``plans``      configuration, campaigns, progress, registered queries
``streaming``  the same steps over streams
"""
