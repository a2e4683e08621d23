from dispatchflow.cli import main

main()
