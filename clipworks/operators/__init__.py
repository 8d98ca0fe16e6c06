"""Set-based jobs: every public function takes and returns DataFrames."""
