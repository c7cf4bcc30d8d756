from spanloom.cli import main

main()
