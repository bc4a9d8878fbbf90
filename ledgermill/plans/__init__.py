"""The layers, the checks on them, the reports, and the job that runs them all."""
