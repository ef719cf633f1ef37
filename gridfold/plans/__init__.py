"""Join plans shared by the operators, and declared pipelines."""
